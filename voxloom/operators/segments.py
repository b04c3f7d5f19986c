"""Ordered scans of keys of any size, cut into segments.

Rows are dealt by ranges of (key, order), so a key with many rows lies in many tasks,
and packed into segments of bounded length, a row each. What a scan does is then
computed in parallel for all segments, as a function of the state in which a segment
is entered; only these functions (or states) are put together along a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import on_workers, written

SIZE = 5_000  # rows of a segment


def packed(rows: DataFrame, key: str, order: list[Column | str], size: int = SIZE, columns: list[str] | None = None) -> DataFrame:
    """(key, part, seq, an array of each other column, or of those named) of rows with a key; (part, seq) is the order of a key's segments."""
    on_workers(rows.sparkSession)
    kinds = dict(rows.dtypes)
    columns = columns or [c for c in rows.columns if c != key]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, now, held = TaskContext.get().partitionId(), 0, None, []

        def told() -> pd.DataFrame:
            nonlocal seq
            seq += 1
            frame = pd.concat(held, ignore_index=True)
            return pd.DataFrame({key: [now], "part": [part], "seq": [seq], **{c: [list(frame[c])] for c in columns}})

        for batch in batches:
            starts = np.flatnonzero(np.r_[True, batch[key].to_numpy()[1:] != batch[key].to_numpy()[:-1]])
            for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
                of = batch[key].iat[a]
                while a < b:
                    if held and (of != now or sum(map(len, held)) >= size):
                        yield told()
                        held = []
                    now = of
                    room = size - sum(map(len, held))
                    held.append(batch.iloc[a : min(b, a + room)])
                    a += room
        if held:
            yield told()

    known = rows.filter(F.col(key).isNotNull()).withColumn("_own", F.monotonically_increasing_id())  # rows that are alike are dealt out too
    ranged = known.repartitionByRange(key, *order, "_own").sortWithinPartitions(key, *order, "_own").select(key, *columns)
    schema = f"{key} {kinds[key]}, part int, seq int, " + ", ".join(f"{c} array<{kinds[c]}>" for c in columns)
    return written(ranged.mapInPandas(pack, schema), "segments")


def folded(summaries: DataFrame, key: str, schema: str, step: Callable, start: Callable, done: Callable | None = None) -> DataFrame:
    """Puts the summaries of each key's segments together in order.

    step(state, row) -> state. Without done: (key, part, seq, the fields of schema)
    with the state that each segment is entered in (a tuple); with done: (key, done(state))
    once for each key. A key's summaries are read as a stream.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                of = getattr(row, key)
                if state is None or of != now:
                    if state is not None and done:
                        out.append((now, *done(state)))
                    now, state = of, start()
                if not done:
                    out.append((of, row.part, row.seq, *state))
                state = step(state, row)
            yield pd.DataFrame(out, columns=names)
        if state is not None and done:
            yield pd.DataFrame([(now, *done(state))], columns=names)

    kind = dict(summaries.dtypes)[key]
    full = f"{key} {kind}, " + ("" if done else "part int, seq int, ") + schema
    names = [c.split()[0] for c in full.split(", ")]
    return summaries.repartition(key).sortWithinPartitions(key, "part", "seq").mapInPandas(run, full)


def settled(segments: DataFrame, key: str, run: Callable, fresh: str) -> DataFrame:
    """(key, part, seq, entry): the state, as text, in which each segment is entered.

    run(entry, row) -> the state after a segment. All segments are run at once, from a
    fresh state at first; then those run again whose entry is not what the segment
    before has ended in, until none is left. A machine that comes to rest now and then
    needs two or three rounds; one whose end always depends on its entry as many as the
    longest key has segments. Only a count goes to the driver.
    """

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = batch[[key, "part", "seq", "entry"]].copy()
            made["end"] = [run(r.entry, r) for r in batch.itertuples(index=False)]
            yield made

    kind = dict(segments.dtypes)[key]
    schema = f"{key} {kind}, part int, seq int, entry string, end string"
    of_key = Window.partitionBy(key).orderBy("part", "seq")
    known = written(segments.withColumn("entry", F.lit(fresh)).mapInPandas(ends, schema), "segment-states")
    while True:
        told = known.withColumn("_entry", F.coalesce(F.lag("end").over(of_key), F.lit(fresh)))
        wrong = told.filter("entry <> _entry")
        if not wrong.limit(1).count():
            return known.select(key, "part", "seq", "entry")
        again = segments.join(wrong.select(key, "part", "seq", F.col("_entry").alias("entry")), [key, "part", "seq"]).mapInPandas(ends, schema)
        known = written(told.filter("entry = _entry").drop("_entry").unionByName(again), "segment-states")
