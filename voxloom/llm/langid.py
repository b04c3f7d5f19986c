"""Operator 4: language identification by a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: of how many
character n-grams (n 1 to 4, lower case, hashed into `1 << bits` bins) do both
hold one, divided by the root of the product of their counts. A bounded sample
of every language that rows are labelled with (`per_lang` texts of each, by the
smallest seeded hash of doc_id, fewer if all languages have over `most_rows`)
trains one-versus-rest kernel ridge regression on Nyström features of `landmarks`
texts a language (fewer beyond `most_landmarks` in all).

With P the 0/1 presence matrix of a batch and L that of the landmarks, the
decisions are `(P @ L.T) / norms @ A`. As the kernel is a scalar product of the
presences, `L.T @ A` is formed once, and a batch is scored by one product of
matrices, with the same result.

Defined cases: a null text or one without a letter is `und`, score 0, as is
every text if nothing can be learned. Equal decisions go to the language first
in order. Rows repeat as often as they come; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import keyed, sample_ids, unkeyed
from voxloom.llm.quality import remainder
from voxloom.session import on_workers

BITS, ORDERS = 15, (1, 2, 3, 4)
PER_LANG, LANDMARKS, MOST_ROWS, MOST_LANDMARKS = 250, 64, 16_000, 2_048
_LETTER = re.compile(r"[^\W\d_]")


def presence(text: str, bits: int = BITS) -> np.ndarray:
    """The bins of a text's n-grams, each once."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    seen = np.zeros(1 << bits, bool)
    x = np.zeros(len(points), np.uint32)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(points) < n:
                break
            x = x[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
            y = x ^ (x >> np.uint32(15))
            seen[(y * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)] = True
    return np.flatnonzero(seen)


def _dense(found: list[np.ndarray], bits: int) -> np.ndarray:
    """The presence matrix, each row divided by the root of its count."""
    out = np.zeros((len(found), 1 << bits), np.float32)
    for row, index in zip(out, found, strict=True):
        row[index] = 1 / np.sqrt(max(1, len(index)))
    return out


def train(found: list[np.ndarray], langs: list[str], *, bits: int = BITS, landmarks: int = LANDMARKS, most_landmarks: int = MOST_LANDMARKS, ridge: float = 0.01, at_once: int = 256) -> tuple[list[str], np.ndarray]:
    """The languages in order and the (bins, languages) matrix of their decisions. Texts are taken at_once, so no matrix of all texts and bins is made."""
    names = sorted(set(langs))
    number = {name: k for k, name in enumerate(names)}
    of = np.array([number[x] for x in langs])
    each = max(1, min(landmarks, most_landmarks // len(names)))
    nth = np.zeros(len(of), np.int64)  # place of a text among those of its language
    for k in range(len(names)):
        nth[of == k] = np.arange((of == k).sum())
    chosen = np.flatnonzero(nth < each)[:most_landmarks]
    marks = _dense([found[k] for k in chosen], bits)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * max(values.max(), 1e-12)
    to_features = vectors[:, good] / np.sqrt(values[good])
    weight = len(of) / (len(names) * np.bincount(of, minlength=len(names)))[of]
    gram, sides = np.zeros((good.sum() + 1,) * 2), np.zeros((good.sum() + 1, len(names)))
    for at in range(0, len(of), at_once):
        part = slice(at, at + at_once)
        phi = np.hstack([(_dense(found[part], bits) @ marks.T).astype(np.float64) @ to_features, np.ones((len(of[part]), 1))])
        gram += phi.T @ (phi * weight[part, None])
        sides += phi.T @ (np.where(of[part, None] == np.arange(len(names)), 1.0, -1.0) * weight[part, None])
    w = np.linalg.solve(gram + ridge * np.eye(len(gram)), sides)
    per_bin = marks.T.astype(np.float64) @ (to_features @ w[:-1])
    return names, np.vstack([per_bin, w[-1:]]).astype(np.float32)


def fit(docs: DataFrame, *, bits: int = BITS, per_lang: int = PER_LANG, most_rows: int = MOST_ROWS, seed: int = 4, **options) -> tuple[list[str], np.ndarray]:
    """Learns from rows of docs (doc_id, text, lang) that have all three."""
    on_workers(docs.sparkSession)
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    rows = usable.select("doc_id", "lang").distinct()
    n_langs = rows.select("lang").distinct().count()
    if not n_langs:
        return [], np.zeros((0, 0), np.float32)
    chosen = sample_ids(rows, "doc_id", "lang", max(1, min(per_lang, most_rows // n_langs)), seed)  # most_rows rows at most, or one a language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "bins": [presence(t, bits).astype(np.int32) for t in batch["text"]]})

    texts = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # an id may come again
    found = texts.mapInPandas(run, "doc_id long, lang string, bins array<int>").toArrow()
    ids, langs, bins = found["doc_id"].to_pylist(), found["lang"].to_pylist(), found["bins"]
    order = sorted(range(len(ids)), key=lambda k: (ids[k], langs[k]))
    return train([bins[k].values.to_numpy().astype(np.int64) for k in order], [langs[k] for k in order], bits=bits, **options) if order else ([], np.zeros((0, 0), np.float32))


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray, *, bits: int = BITS, at_once: int = 64) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text)."""
    model = on_workers(docs.sparkSession).sparkContext.broadcast((names, matrix))  # 4 << bits bytes a language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = model.value
        for batch in batches:
            lang, score = np.full(len(batch), "und", object), np.zeros(len(batch))
            rows = [k for k, t in enumerate(batch["text"]) if t and _LETTER.search(t)] if names else []
            for at in range(0, len(rows), at_once):
                part = rows[at : at + at_once]
                decided = _dense([presence(batch["text"].iat[k], bits) for k in part], bits) @ matrix[:-1] + matrix[-1]
                best = decided.argmax(axis=1)
                lang[part] = [names[b] for b in best]
                score[part] = np.clip((decided[np.arange(len(part)), best] + 1) / 2, 0, 1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": lang, "score": score})

    return unkeyed(keyed(docs).mapInPandas(run, "doc_id long, lang_pred string, score double"))


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs. Learns from rows that aren't held out."""
    names, matrix = fit(docs.filter(remainder(3) != 1), **options)
    return predict(docs, names, matrix).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")
