"""Operator 12: importance resampling towards a target distribution (DSIR; Xie et al., 2023).

A text's words (A-Z lower-cased; digits, letters and all beyond ASCII) give its
features: every run of 1 to n consecutive words, joined by one space, in the bucket
that its CRC-32 has modulo `buckets`. Bucket shares of the whole corpus and of the
target texts, both smoothed by one, say what a feature gains; a document's weight is
the sum of its features' gains. Adding Gumbel noise, fixed by the document's id, and
taking the highest scores draws without replacement in proportion to exp(weight).

Features are made in one scan of a document: a ring keeps the running CRC states of
the last n starts. Each word extends every one of them by a space and itself, and
begins a state of its own; each state is a feature's CRC, so no run is ever joined.

The corpus is read twice, for the counts and for the weights. A task hands on one
count for each bucket; the gains, a number for each bucket, are all that the driver
and the tasks share. Rows are ranked by ranges of (score, doc_id, a number of the
row's own), so that equal rows don't meet in one task; the driver holds a count for
each range.

Defined cases: a null, empty or wordless text has no features and weight 0; a null
doc_id takes the noise of the empty id and comes before other ids; repeated rows are
drawn each on its own and are ranked next to each other, in any order; without target
texts (or documents) all counts of them are 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import LEAST, keyed, unkeyed, written
from voxloom.session import on_workers

MOST_BUCKETS = 1 << 22  # a gain each goes to every worker
PER_RANGE, MOST_RANGES = 20_000, 20_000
#: What each byte of UTF-8 becomes: letters and digits in lower case, all beyond ASCII as it is, else a space.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def ring_states(found: list[bytes], n: int) -> list[int]:
    """The CRC-32 of every run of 1 to n consecutive words, by end and then by start."""
    ring: list[int] = []
    out: list[int] = []
    for word in found:
        if n > 1:
            if len(ring) == n:
                del ring[0]  # its run has n words
            more = b" " + word
            ring = [crc32(more, state) for state in ring]
            ring.append(crc32(word))
        else:
            ring = [crc32(word)]
        out += ring
    return out


def features(found: list[bytes], n: int, buckets: int) -> np.ndarray:
    """The buckets of all features, repeats included."""
    return np.array(ring_states(found, n), np.uint32) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, *, n: int, buckets: int) -> np.ndarray:
    """How many features all texts (text) have in each bucket."""
    on_workers(texts.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(features(words(text), n, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    out = np.zeros(buckets, np.int64)
    found = texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each bucket
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target's share / corpus' share)) of each bucket, both smoothed by one."""
    of, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_raw + of) / ((s + 1) * (all_target + of)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, *, n: int) -> DataFrame:
    """doc_id (keyed), n_words, n_features, weight of every row of docs (doc_id, text)."""
    spark = on_workers(docs.sparkSession)
    shared = spark.sparkContext.broadcast(gains)  # 8 bytes a bucket

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain = shared.value
        for batch in batches:
            found = [words(text) for text in batch["text"]]
            at = [features(x, n, len(gain)) for x in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": [len(x) for x in found], "n_features": [len(x) for x in at], "weight": [int(gain[x].sum()) for x in at]})

    return keyed(docs).mapInPandas(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int):
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of `seed:doc_id`."""
    name = F.concat(F.lit(f"{seed}:"), F.when(doc_id != LEAST, doc_id.cast("string")).otherwise(""))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, targets: DataFrame, *, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, per_range: int = PER_RANGE, most_ranges: int = MOST_RANGES) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (doc_id, text). targets: text of the target distribution.

    Of the rows with least_words words, the percent of 100 with the highest scores
    are drawn and ranked from 1; the others' rank is null.
    """
    if not 0 < buckets <= MOST_BUCKETS or n < 1:
        raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}, n at least 1")
    gains = bucket_gains(bucket_counts(docs, n=n, buckets=buckets), bucket_counts(targets, n=n, buckets=buckets))
    scored = weights(docs, gains, n=n)
    scored = scored.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), F.monotonically_increasing_id().alias("own"))
    scored = written(scored, "scores")
    able = scored.filter(F.col("n_words") >= least_words)
    count = able.count()
    draw = percent * count // 100

    order = (F.col("score").desc(), F.col("doc_id"), F.col("own"))
    ranges = max(1, min(most_ranges, -(-count // per_range)))
    low = (1 << 33) - 1
    ranged = able.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged.select("doc_id", "n_features", "weight", "score", F.shiftright("_at", 33).alias("range"), F.col("_at").bitwiseAND(low).alias("nth")), "ranked")
    starts, before = [], 0
    for r in sorted(ranged.groupBy("range").count().collect()):  # a row for each range
        starts.append((int(r[0]), before))
        before += int(r[1])
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "range long, start long"))
    nth = F.col("start") + F.col("nth") + 1
    ranked = ranged.join(starts, "range").select("doc_id", "n_features", "weight", "score", F.when(nth <= draw, nth).alias("rank"))
    others = scored.filter(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return unkeyed(ranked.unionByName(others))
