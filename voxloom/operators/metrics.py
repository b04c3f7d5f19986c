"""Live metrics over ordered events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.segments import SIZE, folded, packed

# Throttles, smoothing and waiting times.
PROGRESS_MS, LEVEL_MS = 100, 33
SAMPLE_GAP_S, OLD_SHARE = 0.5, 0.8
QUIET_MS, RESTORE_MS, FAILED_MS = 200, 8000, 500


def stream_counters(feeds: DataFrame) -> DataFrame:
    """H1: per session: feeds, seconds of audio and of computing, the newest gauge, and the real-time factor (0 without computing)."""
    audio, compute = F.sum("samples") / 16000.0, F.sum("compute_secs")
    return feeds.groupBy("session").agg(F.count("*").alias("feeds"), audio.alias("audio_secs"), compute.alias("compute_secs"), F.max_by("gauge", "seq").alias("gauge"), F.when(compute > 0, audio / compute).otherwise(F.lit(0.0)).alias("rtf"))


class Speed:
    """H2: a smoothed speed in MiB a second, sampled when more than half a second has gone since the last sample."""

    def __init__(self, t: float | None = None, done: float = 0.0, speed: float = 0.0, samples: int = 0) -> None:
        self.t, self.done, self.speed, self.samples = t, done, speed, samples

    def feed(self, t: float, done: float) -> None:
        if self.t is None:
            self.t, self.done = t, done
        elif t - self.t > SAMPLE_GAP_S:
            now = max(0.0, (done - self.done) / 1048576.0 / (t - self.t))
            self.speed = self.speed * OLD_SHARE + now * (1 - OLD_SHARE) if self.speed > 0 else now
            self.t, self.done, self.samples = t, done, self.samples + 1


class Throttle:
    """H3: lets an event through if enough time has gone since the last one, or if it is complete."""

    def __init__(self, every_ms: int, last: int | None = None) -> None:
        self.every, self.last = every_ms, last

    def feed(self, t: int, done: int, total: int) -> bool:
        emit = self.last is None or t - self.last >= self.every or total > 0 and done >= total
        if emit:
            self.last = t
        return emit


def _in_order(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of a key together and in order; tasks read them as a stream, so a key may have any number."""
    return df.repartition(key).sortWithinPartitions(key, *order)


def _first(ok: np.ndarray) -> int:
    return int(ok.argmax()) if ok.any() else len(ok)


def _speeds(t: np.ndarray, done: np.ndarray) -> dict[str, list]:
    """What a segment makes of the last sample (L, D) and speed s before it.

    The next sample is the first event behind L + SAMPLE_GAP_S, one of the segment's first ones up
    to SAMPLE_GAP_S behind its start. For each of these: its time and bytes, and what
    follows when a sample is taken there: samples, the factor and the summand for a
    speed over 0, the speed that comes of 0, time and bytes of the last sample.
    """
    n = len(t)
    # the first event that samples after event i, by the same comparison as one by one
    follow, j = np.full(n, n), 0
    for i in range(n):
        j = max(j, i + 1)
        while j < n and not t[j] - t[i] > SAMPLE_GAP_S:
            j += 1
        follow[i] = j
    samples, factor, summand, zero, last = np.zeros(n, np.int64), np.ones(n), np.zeros(n), np.zeros(n), np.arange(n)
    for i in range(n - 1, -1, -1):
        j = follow[i]
        if j < n:
            now = max(0.0, (done[j] - done[i]) / 1048576.0 / (t[j] - t[i]))
            samples[i], factor[i], last[i] = samples[j] + 1, OLD_SHARE * factor[j], last[j]
            summand[i] = factor[j] * (now * (1 - OLD_SHARE)) + summand[j]
            zero[i] = factor[j] * now + summand[j] if now > 0 else zero[j]
    k = min(n, int(follow[0]) + 1)
    return {"t": t[:k].tolist(), "done": done[:k].tolist(), "n": samples[:k].tolist(), "factor": factor[:k].tolist(), "summand": summand[:k].tolist(), "zero": zero[:k].tolist(), "last_t": t[last[:k]].tolist(), "last_done": done[last[:k]].tolist()}


def _speed_step(state: tuple, row) -> tuple:
    t, done, speed, samples = state
    if t is None:  # the first event of all is where the first sample starts
        return row.last_t[0], row.last_done[0], row.zero[0], samples + row.n[0]
    at = _first(row.t - t > SAMPLE_GAP_S)
    if at == len(row.t):
        return state
    now = max(0.0, (row.done[at] - done) / 1048576.0 / (row.t[at] - t))
    speed = speed * OLD_SHARE + now * (1 - OLD_SHARE) if speed > 0 else now
    speed = row.factor[at] * speed + row.summand[at] if speed > 0 else row.zero[at]
    return row.last_t[at], row.last_done[at], speed, samples + 1 + row.n[at]


def download_speed(progress: DataFrame, key: str = "model_id", size: int = SIZE) -> DataFrame:
    """H2: (key, speed, samples) after each key's last event (t in seconds, downloaded in bytes).

    A key's events are summarised by segments, wherever they lie; what is left to be done in order is a step for each segment.
    """
    rows = progress.select(key, F.col("t").cast("double").alias("t"), F.col("downloaded").cast("double").alias("downloaded"))
    kind = dict(rows.dtypes)[key]

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = pd.DataFrame([_speeds(np.asarray(t, float), np.asarray(d, float)) for t, d in zip(batch["t"], batch["downloaded"], strict=True)], columns=["t", "done", "n", "factor", "summand", "zero", "last_t", "last_done"])
            yield pd.concat([batch[[key, "part", "seq"]].reset_index(drop=True), made], axis=1)

    found = packed(rows, key, ["t", "downloaded"], size).mapInPandas(summed, f"{key} {kind}, part int, seq int, t array<double>, done array<double>, n array<long>, factor array<double>, summand array<double>, zero array<double>, last_t array<double>, last_done array<double>")
    return folded(found, key, "speed double, samples int", _speed_step, lambda: (None, 0.0, 0.0, 0), lambda state: (float(state[2]), int(state[3])))


def _gates(t: np.ndarray, complete: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """For each event, the next that is let through after it (len: none here), and the last one of the chain that it begins."""
    n = len(t)
    follow = np.searchsorted(t, t + every)
    follow = np.maximum(follow, np.arange(n) + 1)
    done = np.append(np.where(complete, np.arange(n), n), n)
    follow = np.minimum(follow, np.minimum.accumulate(done[::-1])[::-1][1:])  # a complete one comes through in any case
    last = np.arange(n + 1)
    for i in range(n - 1, -1, -1):
        if follow[i] < n:
            last[i] = last[follow[i]]
    return follow, last[:n]


def throttled(events: DataFrame, key: str = "key", every_ms: int = PROGRESS_MS, size: int = SIZE, ties: tuple[str, ...] = ("done", "total")) -> DataFrame:
    """H3: the events (t_ms, done, total) of each key that are emitted; those of one time are taken in the order of ties, nulls last.

    Events without a time come last; of these, complete ones are emitted, and the first of a key that has no others.

    A segment says for each of its first events (up to every_ms behind its start, or the
    first complete one) which one it emits last if that is its first; so the
    time of the last emission before each segment is known in a step for each, and all segments emit at once.
    """
    rows = events.select(key, F.col("t_ms").cast("long").alias("t_ms"), F.col("done").cast("long").alias("done"), F.col("total").cast("long").alias("total"), *(F.col(c).alias(f"_tie{i}") for i, c in enumerate(ties)))
    kind, out = dict(rows.dtypes)[key], rows.select(key, "t_ms", "done", "total").schema
    timed = rows.withColumn("timed", F.col("t_ms").isNotNull()).withColumn("t_ms", F.coalesce("t_ms", F.lit(0)))
    order = [F.desc("timed"), F.asc("t_ms"), *(F.asc_nulls_last(f"_tie{i}") for i in range(len(ties)))]
    segments = packed(timed, key, order, size, ["t_ms", "timed", "done", "total"])

    def arrays(row) -> tuple[np.ndarray, np.ndarray, int]:
        """Times and whether complete, and how many have a time."""
        t, done, total = (np.asarray(x, np.int64) for x in (row.t_ms, row.done, row.total))
        return t, (total > 0) & (done >= total), int(np.count_nonzero(row.timed))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                t, complete, n = arrays(row)
                t, complete = t[:n], complete[:n]
                _, last = _gates(t, complete, every_ms)
                k = min(n, int(np.searchsorted(t, t[0] + every_ms)) + 1, _first(complete) + 1) if n else 0
                out.append((getattr(row, key), row.part, row.seq, t[:k].tolist(), t[last[:k]].tolist(), bool(k and complete[k - 1])))
            yield pd.DataFrame(out, columns=[key, "part", "seq", "t", "last", "complete"])

    def step(state: tuple, row) -> tuple:
        if state[0] is None:
            return (int(row.last[0]) if len(row.last) else 0,)  # behind events without a time there are no others
        at = _first(row.t - state[0] >= every_ms)
        if at == len(row.t) and row.complete:
            at -= 1
        return state if at == len(row.t) else (int(row.last[at]),)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, times, untimed, done, total = [], [], [], [], []
            for row in batch.itertuples(index=False):
                t, complete, n = arrays(row)
                follow, _ = _gates(t[:n], complete[:n], every_ms)
                at = 0 if pd.isna(row.entry) else min(_first(t[:n] - int(row.entry) >= every_ms), _first(complete[:n]))
                taken = []
                while at < n:
                    taken.append(at)
                    at = int(follow[at])
                taken += [i for i in range(n, len(t)) if complete[i] or i == 0 and pd.isna(row.entry)]
                keys += [getattr(row, key)] * len(taken)
                times.append(t[taken])
                untimed += [i >= n for i in taken]
                done.append(np.asarray(row.done)[taken])
                total.append(np.asarray(row.total)[taken])
            if keys:
                yield pd.DataFrame({key: keys, "t_ms": pd.arrays.IntegerArray(np.concatenate(times), np.array(untimed)), "done": np.concatenate(done), "total": np.concatenate(total)})

    found = segments.mapInPandas(summed, f"{key} {kind}, part int, seq int, t array<long>, last array<long>, complete boolean")
    entries = folded(found, key, "entry long", step, lambda: (None,))
    return segments.join(entries, [key, "part", "seq"]).select(key, "t_ms", "timed", "done", "total", "entry").mapInPandas(emit, out)


def ring_drops(events: DataFrame, capacity: int, key: str = "session") -> DataFrame:
    """(key, written, dropped) samples of a bounded buffer: writes (n) beyond its capacity lose their newest samples, reads take up to n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, level, written, dropped = None, 0, 0, 0
        names = [key, "written", "dropped"]
        for batch in batches:
            out = []
            for k, _, is_write, n in batch.itertuples(index=False):
                if k != of:
                    if of is not None:
                        out.append((of, written, dropped))
                    of, level, written, dropped = k, 0, 0, 0
                if is_write:
                    taken = min(n, capacity - level)
                    level, written, dropped = level + taken, written + taken, dropped + n - taken
                else:
                    level -= min(n, level)
            yield pd.DataFrame(out, columns=names)
        if of is not None:
            yield pd.DataFrame([(of, written, dropped)], columns=names)

    rows = events.select(key, F.col("seq").cast("long").alias("seq"), "is_write", F.col("n").cast("long").alias("n")).filter(F.col(key).isNotNull())
    return _in_order(rows, key, ["seq"]).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, written long, dropped long")


def percentage(done, total) -> Column:
    """H4: 0 where the total is 0."""
    d, t = (F.col(c) if isinstance(c, str) else c for c in (done, total))
    return F.when(t > 0, d / t * 100.0).otherwise(F.lit(0.0))


def idle_evictions(activity: DataFrame, limit_ms: int, end_ms: int, key: str = "model_id") -> DataFrame:
    """H5: (key, from_ms, evicted_ms) of the gaps without activity (t_ms) that are longer than the limit."""
    w = Window.partitionBy(key).orderBy("t_ms")
    gaps = activity.select(key, "t_ms", F.coalesce(F.lead("t_ms").over(w), F.lit(end_ms)).alias("_next"))
    return gaps.filter(F.col("_next") - F.col("t_ms") > limit_ms).select(key, F.col("t_ms").alias("from_ms"), (F.col("t_ms") + limit_ms).alias("evicted_ms"))


def text_changes(events: DataFrame, key: str = "session", order: str = "seq") -> DataFrame:
    """The events whose committed or tentative text differs from the event before."""
    w = Window.partitionBy(key).orderBy(order)
    now, before = F.struct("committed", "tentative"), F.lag(F.struct("committed", "tentative")).over(w)
    return events.withColumn("_b", before).filter(F.col("_b").isNull() | ~F.col("_b").eqNullSafe(now)).drop("_b")


def receipt_decision(transactions: DataFrame, receipts: DataFrame, now_ms: int) -> DataFrame:
    """(tx, decision): finish when cancelled or lost, when it has been quiet since the last receipt (t_ms) at or after injection, or when the time from publishing is over."""
    last = receipts.join(transactions.select("tx", "injected_ms"), "tx").groupBy("tx").agg(F.max(F.when(F.col("t_ms") >= F.col("injected_ms"), F.col("t_ms"))).alias("last"))
    j = transactions.join(last, "tx", "left")
    over = F.when(F.col("injection_failed"), F.lit(FAILED_MS)).otherwise(F.lit(RESTORE_MS))
    done = F.col("ownership_lost") | F.col("cancelled") | F.coalesce(now_ms - F.col("last") >= QUIET_MS, F.lit(False)) | (now_ms - F.col("published_ms") >= over)
    return j.select("tx", F.when(done, "finish").otherwise("wait").alias("decision"))
