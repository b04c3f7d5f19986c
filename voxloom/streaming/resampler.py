"""S8 on a stream: the delay line of each session is kept in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxloom.operators.polyphase import Line
from voxloom.session import on_workers

OUT = "session string, frame long, samples array<double>"
STATE = "held array<double>, first long, seen long, made long, pending array<double>, frames long"


def resampled_stream(frames: DataFrame, from_hz: int, to_hz: int = 16_000, *, frame: int = 480, delay: int | None = None) -> DataFrame:
    """(session, frame, samples) from frames (session string, seq long, samples array<double>, last boolean): output frames as their samples come; a frame marked last ends its session, and its state goes."""
    on_workers(frames.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.getOption
        line, told = Line(from_hz, to_hz, frame, delay, tuple(kept[:5]) if kept else None), kept[5] if kept else 0
        rows, out, ended = pd.concat(list(batches)).sort_values("seq", kind="stable"), [], False
        for samples, last in zip(rows["samples"], rows["last"], strict=True):
            out += line.push(samples)
            if last:
                out += line.finish()
                ended = True
        if ended:
            state.remove()
        else:
            state.update((*line.state, told + len(out)))
        yield pd.DataFrame({"session": [key[0]] * len(out), "frame": [told + k for k in range(len(out))], "samples": pd.Series([x.tolist() for x in out], dtype=object)})

    return frames.groupBy("session").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
