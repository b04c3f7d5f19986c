"""Voice-activity smoothing and live metrics on streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxloom.operators.metrics import Speed, Throttle


class Smoother:
    """One session: pre-roll of the last frames, run of voiced frames, frames of hangover left."""

    def __init__(self, prefill: int, hangover: int, onset: int, state: tuple | None = None) -> None:
        self.prefill, self.hangover, self.onset = prefill, hangover, onset
        held, self.speech, self.left, self.run = state or ([], False, 0, 0)
        self.held: deque[int] = deque(held, maxlen=prefill + 1)

    @property
    def state(self) -> tuple:
        return list(self.held), self.speech, self.left, self.run

    def push(self, i: int, voiced: bool) -> list[int]:
        """The frames that are emitted with frame i."""
        self.held.append(i)
        if not voiced:
            self.run = 0
            if self.speech and self.left:
                self.left -= 1
                return [i]
            self.speech = False
            return []
        if not self.speech:
            self.run += 1
            if self.run < self.onset:
                return []
            self.speech, self.left, self.run = True, self.hangover, 0
            return list(self.held)
        self.left = self.hangover
        return [i]


def smoothed_stream(frames: DataFrame, prefill: int, hangover: int, onset: int) -> DataFrame:
    """S1 for a stream of (session, i, voiced) whose frames come in order batch by batch: (session, i) as often as emitted."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        smoother = Smoother(prefill, hangover, onset, (state.get[0], state.get[1], state.get[2], state.get[3]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values("i")
        out = [j for i, v in zip(rows["i"], rows["voiced"], strict=True) for j in smoother.push(int(i), bool(v))]
        held, speech, left, run_length = smoother.state
        state.update((held, speech, left, run_length))
        yield pd.DataFrame({"session": [key[0]] * len(out), "i": out})

    kind = dict(frames.dtypes)["session"]
    return frames.groupBy("session").applyInPandasWithState(run, f"session {kind}, i long", "held array<long>, speech boolean, left long, run long", "append", GroupStateTimeout.NoTimeout)


def download_speed_stream(progress: DataFrame) -> DataFrame:
    """H2 for a stream of (model_id, t, downloaded): the smoothed speed after each batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        meter = Speed(*state.get) if state.exists else Speed()
        for t, d in pd.concat(list(batches)).sort_values("t")[["t", "downloaded"]].itertuples(index=False):
            meter.feed(float(t), float(d))
        state.update((meter.t, meter.done, meter.speed, meter.samples))
        yield pd.DataFrame({"model_id": [key[0]], "speed": [meter.speed]})

    kind = dict(progress.dtypes)["model_id"]
    return progress.groupBy("model_id").applyInPandasWithState(run, f"model_id {kind}, speed double", "t double, d double, speed double, samples int", "update", GroupStateTimeout.NoTimeout)


def throttled_stream(events: DataFrame, every_ms: int) -> DataFrame:
    """H3 for a stream of (key, t_ms, done, total)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = Throttle(every_ms, state.get[0] if state.exists else None)
        rows = pd.concat(list(batches)).sort_values("t_ms")[["t_ms", "done", "total"]]
        out = [(key[0], int(t), int(done), int(total)) for t, done, total in rows.itertuples(index=False) if gate.feed(int(t), int(done), int(total))]
        state.update((gate.last,))
        yield pd.DataFrame(out, columns=["key", "t_ms", "done", "total"])

    kind = dict(events.dtypes)["key"]
    return events.groupBy("key").applyInPandasWithState(run, f"key {kind}, t_ms long, done long, total long", "last long", "append", GroupStateTimeout.NoTimeout)


def active_sessions_stream(activity: DataFrame, gap: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """H5 for a stream of (model_id, ts): sessions without a gap longer than the limit; each ends in an eviction."""
    timed = activity.select("model_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("model_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("model_id", F.col("w.start").alias("from_ts"), F.col("w.end").alias("evicted_ts"), "events")
