"""T13 with a detector: a naive Bayes model of character n-grams, counted in Spark from a table of texts and their languages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.lang import MIN_CONFIDENCE, THREE_TO_TWO, gated_codes
from voxloom.session import on_workers

BUCKETS, MOST_N, SMOOTHING = 1 << 14, 3, 0.5
LETTERS, MARGIN = 16, 0.05  # a reliable answer has so many letters, and so many nats a letter before the next best
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _folded(text: str) -> np.ndarray:
    """Code points of a text in lower case, runs of anything but letters as one space, one at both ends."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    return np.frombuffer(f" {' '.join(kept.split())} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def gram_buckets(text: str, most_n: int = MOST_N) -> np.ndarray:
    """The buckets of all runs of 1 to most_n characters."""
    points, out = _folded(text), []
    h = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, most_n + 1):
            if len(points) < n:
                break
            h = h[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
            x = (h ^ (h >> np.uint64(30))) * _M1
            x = (x ^ (x >> np.uint64(27))) * _M2
            out.append((x >> np.uint64(40)) % np.uint64(BUCKETS))
    return np.concatenate(out).astype(np.int64)


class Detector:
    """counts: for each language, how often each bucket comes in its texts."""

    def __init__(self, languages: Sequence[str], counts: np.ndarray) -> None:
        self.languages = list(languages)
        smooth = counts + SMOOTHING
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))

    def detect(self, text: str | None, allowed: Sequence[str] | None = None) -> tuple[str, float, bool] | None:
        """(language, confidence, reliable) of the likeliest of the allowed languages (None: all). The confidence is its share of the likelihood, a run of characters counted once for all its lengths."""
        among = [k for k, x in enumerate(self.languages) if allowed is None or x in allowed]
        letters = sum(map(str.isalpha, text)) if text else 0
        if not among or not letters:
            return None
        found, times = np.unique(gram_buckets(text), return_counts=True)
        total = (self.logs[np.ix_(among, found)] * times).sum(axis=1) / MOST_N
        order = np.argsort(-total, kind="stable")
        share = np.exp(total - total[order[0]])
        margin = (total[order[0]] - total[order[1]]) / letters if len(among) > 1 else np.inf
        return self.languages[among[order[0]]], float(1 / share.sum()), letters >= LETTERS and margin >= MARGIN


def fitted(samples: DataFrame) -> Detector:
    """The detector of a table of samples (text, language), all of which count. Languages x BUCKETS numbers go to the driver."""
    on_workers(samples.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, language in zip(batch["text"], batch["language"], strict=True):
                own = total.setdefault(language, np.zeros(BUCKETS, np.int64))
                own += np.bincount(gram_buckets(text), minlength=BUCKETS)
        for language, own in total.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"language": language, "bucket": at, "n": own[at]})

    rows = samples.select("text", "language").dropna().mapInPandas(count, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(rows["language"].to_pylist()))
    counts = np.zeros((len(languages), BUCKETS))
    place = {x: k for k, x in enumerate(languages)}
    counts[[place[x] for x in rows["language"].to_pylist()], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return Detector(languages, counts)


def detected(rows: DataFrame, detector: Detector, text: str = "text", codes: str | None = None) -> DataFrame:
    """Rows with `detected` (language, confidence, reliable) and `output_language`: the language, if the answer is reliable and confident enough.

    codes: a column with the codes of the languages that a row's model can output. An
    empty list (or null) is no constraint; codes of languages that the detector doesn't know are
    left out, and if none is left, nothing is told.
    """
    shared = on_workers(rows.sparkSession).sparkContext.broadcast(detector)  # 8 bytes for each language and bucket

    @F.pandas_udf("struct<language: string, confidence: double, reliable: boolean>")
    def told(texts: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        found = [shared.value.detect(t if isinstance(t, str) else None, None if c is None or not len(c) else set(c)) for t, c in zip(texts, wanted, strict=True)]
        return pd.DataFrame([x or (None, None, None) for x in found], columns=["language", "confidence", "reliable"])

    known = {**THREE_TO_TWO, **{x: x for x in detector.languages}}
    given = F.coalesce(F.col(codes), F.array().cast("array<string>")) if codes else F.array().cast("array<string>")
    allowed = F.when(F.size(given) == 0, given).otherwise(gated_codes(given, known))
    shut = (F.size(given) > 0) & (F.size(F.array_intersect(allowed, F.array(*map(F.lit, detector.languages)))) == 0)
    out = rows.withColumn("detected", F.when(~shut, told(text, allowed)))
    sure = F.col("detected.reliable") & (F.col("detected.confidence") >= MIN_CONFIDENCE)
    return out.withColumn("output_language", F.when(sure, F.col("detected.language")))
