"""Resampling of streams of frames by a polyphase filter, a windowed sinc.

Output n is the sum of the input samples near n from/to, weighted by the filter. So it
depends on `reach` samples to both sides and on nothing else: a stream can be cut
anywhere, if each part has that much of its neighbours.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import on_workers

ZEROS = 16  # crossings of the sinc to each side
CHUNK = 1024  # samples that a block resampler takes at once; its output is late by half of that


class Filter:
    """For rates from_hz to to_hz: `up` / `down` is the ratio in lowest terms."""

    def __init__(self, from_hz: int, to_hz: int, zeros: int = ZEROS) -> None:
        common = math.gcd(from_hz, to_hz)
        self.up, self.down = to_hz // common, from_hz // common
        slower = max(self.up, self.down)
        self.half = zeros * slower
        m = np.arange(-self.half, self.half + 1)
        self.taps = self.up / slower * np.sinc(m / slower) * 0.5 * (1 + np.cos(np.pi * m / self.half))
        self.reach = -(-self.half // self.up)

    def values(self, x: np.ndarray, first: int, begin: int, end: int) -> np.ndarray:
        """Outputs begin to end of a stream, of which x holds the samples from number `first` on; what x lacks is 0."""
        at = np.arange(begin, end)[:, None] * self.down
        k = -((self.half - at) // self.up) + np.arange(2 * self.half // self.up + 1)
        tap = at - k * self.up + self.half
        place = k - first
        inside = (tap >= 0) & (tap <= 2 * self.half) & (place >= 0) & (place < len(x))
        return (np.where(inside, x[np.clip(place, 0, max(0, len(x) - 1))], 0.0) * self.taps[np.clip(tap, 0, 2 * self.half)]).sum(axis=1) if len(x) else np.zeros(end - begin)


def delay_of(from_hz: int, to_hz: int, chunk: int = CHUNK) -> int:
    return round(chunk * to_hz / from_hz / 2) if from_hz != to_hz else 0


def resampled_frames(frames: DataFrame, from_hz: int, to_hz: int = 16_000, *, frame: int = 480, delay: int | None = None, frames_at_once: int = 64) -> DataFrame:
    """(session, frame, samples) from frames (session, seq, samples), in order of seq: whole frames of the output, the last filled up with zeros.

    A session's output has in * to / from samples and `delay` zeros before them. Its
    input frames go to the blocks of output frames that need any of their samples, so
    a long session is spread; the window that numbers its samples sees lengths alone.
    """
    on_workers(frames.sparkSession)
    made, late, wide = Filter(from_hz, to_hz), delay_of(from_hz, to_hz) if delay is None else delay, frame * frames_at_once
    of = Window.partitionBy("session").orderBy("seq")
    sizes = frames.select("session", "seq", F.size("samples").cast("long").alias("n"))
    sizes = sizes.select("session", "seq", (F.sum("n").over(of) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy("session")).alias("total"))
    rows = frames.select("session", "seq", F.col("samples").cast("array<double>").alias("samples")).join(sizes, ["session", "seq"])
    length = F.expr(f"total * {made.up} div {made.down}") + F.when(F.col("total") > 0, late).otherwise(0)
    last = F.expr(f"({late} + (start + size(samples) + {made.reach}) * {made.up} div {made.down}) div {wide}")
    first = F.expr(f"greatest(0, ({late} + (start - {made.reach}) * {made.up} div {made.down} - 1) div {wide})")
    whole = F.least(last, F.expr(f"greatest(0, ({late} + total * {made.up} div {made.down} - 1)) div {wide}"))
    # the first block of a session begins with the delay, which no sample may reach
    first = F.when(F.col("start") == 0, F.lit(0)).otherwise(first)
    whole = F.when(F.col("start") + F.size("samples") == F.col("total"), F.expr(f"greatest(0, ({late} + total * {made.up} div {made.down} - 1)) div {wide}")).otherwise(whole)
    parts = rows.filter("total > 0 AND size(samples) > 0").select("session", "start", "samples", length.alias("length"), F.explode(F.sequence(F.least(first, whole).cast("long"), whole.cast("long"))).alias("block"))

    def joined(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", kind="stable")
        begin = int(pdf["start"].iat[0])
        end = int(pdf["start"].iat[-1]) + len(pdf["samples"].iat[-1])
        x = np.zeros(end - begin)
        for start, samples in zip(pdf["start"], pdf["samples"], strict=True):
            x[int(start) - begin : int(start) - begin + len(samples)] = samples
        low, high = int(key[1]) * wide, min((int(key[1]) + 1) * wide, int(pdf["length"].iat[0]))
        y = np.zeros(max(0, high - low))
        if (a := max(low, late)) < high:
            y[a - low :] = made.values(x, begin, a - late, high - late)
        y = np.pad(y, (0, -len(y) % frame))
        return pd.DataFrame({"session": key[0], "frame": low // frame + np.arange(len(y) // frame), "samples": pd.Series(list(y.reshape(-1, frame)), dtype=object)})

    return parts.groupBy("session", "block").applyInPandas(joined, f"session {dict(frames.dtypes)['session']}, frame long, samples array<double>")


class Line:
    """A delay line: takes samples as they come and gives the outputs that they settle; `state` is all that has to be kept between."""

    def __init__(self, from_hz: int, to_hz: int = 16_000, frame: int = 480, delay: int | None = None, state: tuple | None = None) -> None:
        self.filter, self.frame, self.late = Filter(from_hz, to_hz), frame, delay_of(from_hz, to_hz) if delay is None else delay
        held, self.first, self.seen, self.made, pending = state or ([], 0, 0, 0, [])
        self.held, self.pending = np.asarray(held, float), np.asarray(pending, float)

    @property
    def state(self) -> tuple:
        """(samples that later outputs need, number of the first, samples seen, outputs made, outputs of no whole frame)."""
        return self.held.tolist(), self.first, self.seen, self.made, self.pending.tolist()

    def _until(self, end: int) -> list[np.ndarray]:
        if not self.made and self.seen:
            self.pending = np.zeros(self.late)
        if end > self.made:
            self.pending = np.concatenate([self.pending, self.filter.values(self.held, self.first, self.made, end)])
            self.made = end
        need = max(self.first, -((self.filter.half - self.made * self.filter.down) // self.filter.up))
        self.held, self.first = self.held[need - self.first :], max(need, self.first)
        whole = len(self.pending) // self.frame * self.frame
        out, self.pending = self.pending[:whole], self.pending[whole:]
        return list(out.reshape(-1, self.frame))

    def push(self, samples) -> list[np.ndarray]:
        self.held, self.seen = np.concatenate([self.held, np.asarray(samples, float)]), self.seen + len(samples)
        f = self.filter
        settled = max(self.made, ((self.seen - 1) * f.up - f.half) // f.down + 1)  # outputs that need no sample to come
        return self._until(min(settled, self.seen * f.up // f.down)) if settled > self.made else []

    def finish(self) -> list[np.ndarray]:
        out = self._until(self.seen * self.filter.up // self.filter.down)
        if len(self.pending):
            out.append(np.pad(self.pending, (0, self.frame - len(self.pending))))
        self.held, self.first, self.seen, self.made, self.pending = np.zeros(0), 0, 0, 0, np.zeros(0)
        return out
