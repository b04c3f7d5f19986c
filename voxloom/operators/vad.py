"""Voice-activity segmentation of ordered frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE = 16_000
# Milliseconds of pre-roll, hangover (offline, live) and onset; the detectors' thresholds.
PREFILL_MS, HANGOVER_MS, HANGOVER_LIVE_MS, ONSET_MS = 450, 450, 1650, 60
THRESHOLDS = {"strict": 0.3, "inclusive": 0.5}


def frames_for(ms: int, frame: int, rate: int = RATE) -> int:
    """How many frames of so many samples cover a time, rounded up."""
    return -(-ms * rate // (1000 * frame))


def policy_frames(policy: str, frame: int) -> tuple[int, int, int]:
    """Prefill, hangover and onset of a policy, in frames."""
    hangover = HANGOVER_LIVE_MS if policy == "streaming" else HANGOVER_MS
    return frames_for(PREFILL_MS, frame), frames_for(hangover, frame), frames_for(ONSET_MS, frame)


def policy_columns(policy: str, frame: str, rate: int = RATE) -> tuple[Column, Column, Column]:
    """The same of columns: a policy's name and a frame's size."""
    wide = F.lit(1000) * F.col(frame)
    frames = lambda ms: F.ceil(ms * rate / wide).cast("int")
    return frames(F.lit(PREFILL_MS)), frames(F.when(F.col(policy) == "streaming", HANGOVER_LIVE_MS).otherwise(HANGOVER_MS)), frames(F.lit(ONSET_MS))


def voiced(score: Column, kind: str) -> Column:
    """S3: a detector's decision; an error (null or not finite) counts as voice."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, True).otherwise(score > THRESHOLDS[kind] if kind == "strict" else score >= THRESHOLDS[kind])


def smoothed(frames: DataFrame, prefill: int, hangover: int, onset: int) -> DataFrame:
    """(session, i, emitted): how often each frame (session, i, voiced) is emitted.

    Speech starts at the onset-th voiced frame in a row and takes the frames of
    the pre-roll with it, which may have been emitted before; it ends when more
    than hangover frames without voice follow. Running windows alone: each frame
    learns from its session's past and future whether a segment covers it, so a
    session's frames are sorted once and never multiplied.
    """
    s = Window.partitionBy("session").orderBy("i")
    past = s.rowsBetween(Window.unboundedPreceding, 0)
    v, i = F.col("voiced"), F.col("i")
    f = frames.select("session", "i", F.coalesce("voiced", F.lit(False)).alias("voiced"))
    f = f.withColumn("_quiet", F.max(F.when(~v, i)).over(past))  # the last frame without voice
    f = f.withColumn("_rank", F.when(v, i - F.coalesce("_quiet", F.first("i").over(past) - 1)))
    f = f.withColumn("_before", F.max(F.when(v, i)).over(s.rowsBetween(Window.unboundedPreceding, -1)))
    # chains of voiced frames with gaps of no more than hangover frames
    f = f.withColumn("_chain", F.sum(F.when(v & (F.col("_before").isNull() | (i - F.col("_before") - 1 > hangover)), 1).otherwise(0)).over(past))
    c = Window.partitionBy("session", "_chain")
    f = f.withColumn("_onset", F.min(F.when(v & (F.col("_rank") >= onset), i)).over(c)).withColumn("_last", F.max(F.when(v, i)).over(c))
    speech = F.col("_onset").isNotNull() & (i >= F.col("_onset")) & (i <= F.col("_last") + hangover)
    # onsets that follow within reach take this frame as pre-roll
    coming = F.sum(F.when(i == F.col("_onset"), 1).otherwise(0)).over(s.rangeBetween(1, prefill)) if prefill else F.lit(0)
    f = f.withColumn("emitted", F.coalesce(speech, F.lit(False)).cast("long") + F.coalesce(coming, F.lit(0)))
    return f.filter("emitted > 0").select("session", "i", "emitted")


def tail_report(frames: DataFrame, prefill: int, hangover: int, onset: int) -> DataFrame:
    """For each session, the frames at its end that were not emitted (of the last prefill + 1), the voiced ones among them, and whether speech goes on."""
    emitted = smoothed(frames, prefill, hangover, onset).select("session", "i", F.lit(True).alias("_out"))
    order = Window.partitionBy("session").orderBy(F.desc("i"))
    tail = frames.withColumn("_back", F.row_number().over(order)).filter(F.col("_back") <= prefill + 1)
    tail = tail.join(emitted, ["session", "i"], "left").withColumn("_ends", F.min(F.when(F.col("_out"), F.col("_back"))).over(Window.partitionBy("session")))
    held = F.col("_ends").isNull() | (F.col("_back") < F.col("_ends"))
    return tail.groupBy("session").agg(F.count(F.when(held, 1)).alias("withheld"), F.count(F.when(held & F.col("voiced"), 1)).alias("withheld_voiced"), F.max(F.coalesce(F.col("_out") & (F.col("_back") == 1), F.lit(False))).alias("in_speech"))


def downmixed(samples, channels, selected) -> Column:
    """One channel of interleaved samples: the selected one if there is such, else the mean; a trailing part of a frame is dropped."""
    x, n, k = (F.col(c) if isinstance(c, str) else c for c in (samples, channels, selected))
    count = F.floor(F.size(x) / n).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    one = F.transform(at, lambda j: F.element_at(x, j * n + k + 1).cast("double"))
    mean = F.transform(at, lambda j: F.aggregate(F.slice(x, j * n + 1, n), F.lit(0.0), lambda a, b: a + b) / n)
    return F.when(n == 1, F.transform(x, lambda v: v.cast("double"))).when(k.isNotNull() & (k < n), one).otherwise(mean)


def framed(samples, size: int) -> Column:
    """An array of frames of size samples, the last filled up with zeros."""
    x = F.col(samples) if isinstance(samples, str) else samples
    count = F.ceil(F.size(x) / size).cast("int")
    filled = F.concat(x, F.array_repeat(F.lit(0.0), count * size - F.size(x)))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.slice(filled, j * size + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def padded_clip(samples, least: int = RATE, length: int = 20_000) -> Column:
    """A short clip, if not empty, filled up with zeros."""
    x = F.col(samples) if isinstance(samples, str) else samples
    return F.when((F.size(x) > 0) & (F.size(x) < least), F.concat(x, F.array_repeat(F.lit(0.0), length - F.size(x)))).otherwise(x)
