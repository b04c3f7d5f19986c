"""Operator 8: document fingerprints by consistent weighted sampling.

A text is the weighted set of its lower-cased white-space words, weight the
number of occurrences. Sample k of a set is the (word, t) of the least ln a:

    r, c ~ Gamma(2, 1), b ~ U(0, 1), all fixed by the word and k
    t = floor(ln(weight) / r + b),  ln a = ln c - r * (t - b + 1)

so two sets agree in a sample with the probability of their generalised Jaccard
similarity, sum of minima over sum of maxima. A fingerprint is `SAMPLES`
samples of 16 bits each, in hexadecimal; the likeness of two fingerprints is the
share of samples that agree. For one occurrence ln a depends on the word alone;
values are remembered by (word, weight) up to a bound.

The edited text needs the next document in order of doc_id. Documents are dealt
out by ranges of doc_id and each range's first document goes to the range before
it as well, so texts move once, in even ranges, and no window spans all rows.

Defined cases: a null text is empty; a text without words has the fingerprint of
the empty set (all zeros), which is like itself (1) and unlike any other (0).
Rows of one doc_id are ordered by text; a null doc_id comes first. Only one
document: it follows itself.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import LEAST, Hashes, cut_points, mix
from voxloom.session import on_workers

SAMPLES = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Sampler:
    """Remembers ln a and the 16-bit samples of (word, weight) pairs in arrays of a bounded number of rows."""

    def __init__(self, samples: int = SAMPLES, seed: int = 8, most: int = 250_000) -> None:
        self.hashes, self.samples, self.most = Hashes(seed, 100_000), samples, most
        self.rows: dict[tuple[bytes, int], int] = {}
        with np.errstate(over="ignore"):
            self.columns = [(np.arange(samples, dtype=np.uint64) * np.uint64(8) + np.uint64(k + 1)) * _STEP for k in range(3)]
        self.log_a = np.empty((most, samples), np.float32)
        self.bits = np.empty((most, samples), np.uint16)

    def _uniform(self, base: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers in (0, 1) for each word and sample."""
        with np.errstate(over="ignore"):
            x = mix(base[:, None] + self.columns[which][None, :])
        high, low = (x >> np.uint64(32)).astype(np.float32), (x & np.uint64(0xFFFFFFFF)).astype(np.float32)
        scale = np.float32(2.0**-32 * (1 - 2.0**-23))
        return (high + np.float32(0.5)) * scale, (low + np.float32(0.5)) * scale

    def _make(self, pairs: list[tuple[bytes, int]], at: np.ndarray) -> None:
        base = mix(self.hashes.array([w for w, _ in pairs]))
        weight = np.array([n for _, n in pairs], np.float32)[:, None]
        u, v = self._uniform(base, 0)
        r = -np.log(u * v)
        u, v = self._uniform(base, 1)
        log_c = np.log(-np.log(u * v))
        b = self._uniform(base, 2)[0]
        if (weight == 1).all():
            t = np.zeros((len(pairs), 1), np.float32)
        else:
            t = np.floor(np.log(weight) / r + b)
        self.log_a[at] = log_c - r * (t - b + 1)
        with np.errstate(over="ignore"):
            self.bits[at] = (mix(base[:, None] + (t + 1).astype(np.int64).astype(np.uint64) * _STEP) >> np.uint64(48)).astype(np.uint16)

    def places(self, pairs: list[tuple[bytes, int]]) -> np.ndarray:
        """The rows of pairs, of which there are no more than the bound."""
        get = self.rows.get
        at = np.array([get(p, -1) for p in pairs], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.rows) + len(new) > self.most:
                self.rows.clear()
                return self.places(pairs)
            at[new] = np.arange(len(self.rows), len(self.rows) + len(new))
            once = [k for k in new.tolist() if pairs[k][1] == 1]
            more = [k for k in new.tolist() if pairs[k][1] > 1]
            for part in (once, more):  # most words occur once, which is cheaper
                if part:
                    self._make([pairs[k] for k in part], at[part])
            self.rows.update((pairs[k], int(at[k])) for k in new.tolist())
        return at

    def sample(self, text: str | None) -> np.ndarray | None:
        """The samples of a text; None without words."""
        words = text.encode("utf-8", "replace").lower().split() if text else []
        if not words:
            return None
        pairs = list(Counter(words).items())
        best, out = None, None
        for k in range(0, len(pairs), 2048):
            at = self.places(pairs[k : k + 2048])
            log_a = self.log_a[at]
            least = log_a.argmin(axis=0)
            column = np.arange(self.samples)
            low, bits = log_a[least, column], self.bits[at[least], column]
            if best is None:
                best, out = low, bits
            else:
                better = low < best
                best, out = np.where(better, low, best), np.where(better, bits, out)
        return out


def hexadecimal(samples: np.ndarray | None, size: int = SAMPLES) -> str:
    return "0000" * size if samples is None else samples.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    return float(a is b) if a is None or b is None else float((a == b).mean())


def edited(text: str, after: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_SAMPLERS: dict[int, Sampler] = {}


def fingerprints(docs: DataFrame, *, samples: int = SAMPLES, per_range: int = 500, most_ranges: int = 100_000) -> DataFrame:
    """A row for each row of docs (doc_id, text): fingerprints of its text and edited text, and their likenesses."""
    spark = on_workers(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    count = rows.count()
    bounds = cut_points(rows, "_id", count, min(most_ranges, -(-count // per_range)))
    cuts = spark.sparkContext.broadcast(bounds)  # 8 bytes for per_range documents, most_ranges at most

    def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"range": np.searchsorted(cuts.value, batch["_id"].to_numpy(), "right") - 1, "_id": batch["_id"]})

    # the first document of each range: ids alone, then the least text of that id
    firsts = {r["range"]: r["first"] for r in rows.select("_id").mapInPandas(ranged, "range long, _id long").groupBy("range").agg(F.min("_id").alias("first")).collect()} if len(bounds) else {}
    order = sorted(firsts)
    follows = {firsts[b]: a for a, b in zip(order, [*order[1:], *order[:1]], strict=True)}  # the last is followed by the first
    leads = spark.sparkContext.broadcast(follows)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = np.searchsorted(cuts.value, batch["_id"].to_numpy(), "right") - 1
            own = pd.DataFrame({"range": part, "tail": 0, "_id": batch["_id"], "text": batch["text"]})
            lead = batch["_id"].isin(leads.value.keys()).to_numpy()
            more = batch[lead]
            tail = pd.DataFrame({"range": [leads.value[i] for i in more["_id"]], "tail": 1, "_id": more["_id"], "text": more["text"]})
            yield pd.concat([own, tail]) if len(more) else own

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = _SAMPLERS.setdefault(samples, Sampler(samples))
        held = None  # range, id, text and samples of the document before
        closed = None  # the range whose follower has been used

        def row(one: tuple, text: str, own: np.ndarray | None) -> tuple:
            changed = edited(one[2], text)
            near = sampler.sample(changed)
            return (one[1], len(one[2]), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), hexadecimal(one[3], samples), hexadecimal(near, samples), likeness(one[3], near), likeness(one[3], own))

        for batch in batches:
            out = []
            for part, tail, i, text in zip(batch["range"], batch["tail"], batch["_id"], batch["text"], strict=True):
                if tail and closed == part:
                    continue  # a follower of this id with a later text
                own = sampler.sample(text)
                if held is not None and held[0] == part:
                    out.append(row(held, text, own))
                held = (part, i, text, own) if not tail else None
                closed = part if tail else closed
            if out:
                made = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                made["doc_id"] = made["doc_id"].astype("Int64").mask(made["doc_id"] == LEAST)
                yield made

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(bounds) // 16)  # ranges of a few thousand documents to a task
    moved = rows.mapInPandas(dealt, "range long, tail int, _id long, text string").repartition(parts, "range").sortWithinPartitions("range", "tail", "_id", "text")
    return moved.mapInPandas(finish, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
