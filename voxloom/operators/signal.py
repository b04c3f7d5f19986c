"""Spectrum levels and resampling of sample arrays (S7, S8), as Arrow UDFs over numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the level display.
BUCKETS, LOW_HZ, HIGH_HZ = 16, 400.0, 4000.0
DB_LOW, DB_HIGH, GAIN, CURVE, SILENCE_DB = -68.0, -30.0, 1.3, 0.7, -80.0


def bucket_bins(window: int, rate: int, buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """Spectrum bins of each bucket, spaced by squares, one bin at least."""
    edge = (np.arange(buckets + 1, dtype=np.float32) / np.float32(buckets)) ** 2
    hz = np.float32(LOW_HZ) + np.float32(HIGH_HZ - LOW_HZ) * edge
    at = (hz * window / rate).astype(int)
    half = window // 2
    return [(min(a, half), min(max(b, a + 1), half)) for a, b in zip(at[:-1], at[1:], strict=True)]


def levels(samples: np.ndarray, window: int, rate: int = 16_000) -> np.ndarray | None:
    """The levels of the first window of samples; None if there are fewer."""
    if len(samples) < window:
        return None
    x = np.asarray(samples[:window], np.float32).astype(np.float64)
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(window) / window))
    power = np.abs(np.fft.fft((x - x.mean()) * hann)) ** 2
    out = np.zeros(BUCKETS)
    for k, (a, b) in enumerate(bucket_bins(window, rate)):
        if a < b <= window // 2:
            mean = power[a:b].mean()
            db = 20 * np.log10(np.sqrt(mean) / window) if mean > 1e-12 else SILENCE_DB
            out[k] = np.clip((np.clip((db - DB_LOW) / (DB_HIGH - DB_LOW), 0, 1) * GAIN) ** CURVE, 0, 1)
    for k in range(1, BUCKETS - 1):  # each takes its left neighbour as smoothed already
        out[k] = 0.7 * out[k] + 0.15 * out[k - 1] + 0.15 * out[k + 1]
    return out


def spectrum(samples, window: int = 512, rate: int = 16_000) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda s: levels(np.asarray(s, np.float32), window, rate), na_action="ignore")

    return run(F.col(samples) if isinstance(samples, str) else samples)


def resampled(samples: np.ndarray, from_hz: int, to_hz: int = 16_000, frame: int = 480, chunk: int = 1024) -> np.ndarray:
    """Band-limited resampling, late by half a chunk as block resamplers are, filled up to whole frames. Lengths are those of a stream in chunks; another filter's values are not reproduced."""
    x = np.asarray(samples, np.float64)
    if from_hz != to_hz and len(x):
        n, delay = len(x) * to_hz // from_hz, round(chunk * to_hz / from_hz / 2)
        bins = np.fft.rfft(x)[: n // 2 + 1]
        made = np.fft.irfft(bins, n) * (n / len(x)) if n else np.zeros(0)
        x = np.concatenate([np.zeros(delay), made])
    return np.pad(x, (0, -len(x) % frame)).astype(np.float32)


def resample(samples, from_hz: int, to_hz: int = 16_000, frame: int = 480) -> Column:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda s: resampled(s, from_hz, to_hz, frame), na_action="ignore")

    return run(F.col(samples) if isinstance(samples, str) else samples)
