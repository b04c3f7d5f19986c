"""Operator 9: quality classifier. Hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features of a text, each an n-gram of its white-space words hashed into `1 << bits`
bins: lower-cased words (n 1 to 2), word shapes such as `Aa`, `A!`, `0` or `|`
(n 1 to 3), and whether a word repeats the one before (n 1 to 3). A feature's
value is its share of the n-grams of its kind, so length alone says nothing.
Training is FTRL-proximal with per-coordinate rates on a bounded sample:
`per_class` labelled rows of each label, those of the smallest seeded hash of
doc_id (of rows with one id the least text). Scoring is a sparse dot product and a logistic function.

Defined cases: rows with a null id, label or text are not learned from; a null
text scores as an empty one, whose only evidence is the bias; with no usable
labels every score is 0.5; with one label only, that label's side. Rows repeat
as often as they come; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import Hashes, hold, ngrams, sample_ids
from voxloom.session import on_workers

BITS = 18
PER_CLASS = 1000
THRESHOLD = 0.7
_RUN = re.compile(r"(.)\1+", re.S)


class Shapes(dict):
    """Word to (hash of its lower case, hash of its shape), remembered up to a bound."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.shapes = Hashes(9, 50_000), Hashes(10, 50_000)

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= 180_000:
            self.clear()
        shape = "".join(["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word])
        made = self.hashes[word.lower().encode()], self.shapes[_RUN.sub(r"\1", shape).encode()]
        if len(word) <= 64:
            self[word] = made
        return made


_SHAPES = Shapes()


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bins and values of a text; bin 0 is the bias."""
    words = text.split() if text else []
    found, values = [np.zeros(1, np.int64)], [np.ones(1)]
    if words:
        both = np.array([_SHAPES[w] for w in words], np.uint64)
        same = np.concatenate([[False], both[1:, 0] == both[:-1, 0]]).astype(np.uint64)
        for kind, (stream, orders) in enumerate(((both[:, 0], (1, 2)), (both[:, 1], (1, 2, 3)), (same, (1, 2, 3)))):
            for n in orders:
                grams = ngrams(stream + np.uint64(kind * 1_000_003 + 1), n)
                found.append(1 + (grams % np.uint64((1 << bits) - 1)).astype(np.int64))
                values.append(np.full(len(grams), 1 / len(grams)))
    index, at = np.unique(np.concatenate(found), return_inverse=True)
    return index, np.bincount(at, np.concatenate(values))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, *, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 9) -> np.ndarray:
    """Weights after FTRL-proximal passes over (bins, values, label) in seeded orders."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    rng = np.random.default_rng(seed)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, x, y = rows[k]
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[index] = ni + g * g
    return weights(z, n).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, *, bits: int = BITS, per_class: int = PER_CLASS, seed: int = 9) -> np.ndarray:
    """Weights learned from docs (doc_id, text) and labels (doc_id, quality); see the module for the sample."""
    on_workers(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
    chosen = sample_ids(usable, "doc_id", "quality", per_class, seed)  # two strata: a few thousand rows at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold(_SHAPES)
        for batch in batches:
            made = [features(t, bits) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "bins": [m[0] for m in made], "value": [m[1] for m in made]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # an id may come again
    rows = texts.mapInPandas(run, "doc_id long, quality int, bins array<long>, value array<double>").collect()  # 2 * per_class at most
    rows.sort(key=lambda r: (r.doc_id, r.quality))
    return train([(np.array(r.bins), np.array(r.value), r.quality) for r in rows], bits)


def scorer(spark: SparkSession, weights: np.ndarray, bits: int = BITS):
    """A column function of text to score."""
    model = on_workers(spark).sparkContext.broadcast(weights)  # 4 << bits bytes

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = model.value
        hold(_SHAPES)
        for batch in batches:
            sums = np.array([float(w[i] @ x) for i, x in (features(t, bits) for t in batch)], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -35, 35))))

    return run


def remainder(of: int) -> F.Column:
    """crc32(doc_id as text) mod `of`; 0 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of, F.lit(0))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. Learns from rows that aren't held out."""
    weights = fit(docs, labels.filter(remainder(4) != 2), **options)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(docs.sparkSession, weights)("text").alias("score"))
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of docs, with their columns, that score THRESHOLD or more."""
    return docs.filter(scorer(docs.sparkSession, weights)("text") >= THRESHOLD)
