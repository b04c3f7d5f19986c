import random

import numpy as np
import pytest

from voxloom.operators.polyphase import Filter, Line, delay_of, resampled_frames
from voxloom.streaming.resampler import resampled_stream


def plain(x, from_hz, to_hz, frame, delay):
    """The convolution of the samples, filled with zeros between, with the taps; output by output."""
    f = Filter(from_hz, to_hz)
    y = [sum(v * f.taps[n * f.down - k * f.up + f.half] for k, v in enumerate(x) if abs(n * f.down - k * f.up) <= f.half) for n in range(len(x) * f.up // f.down)]
    y = [0.0] * delay + y if len(x) else []
    return np.array(y + [0.0] * (-len(y) % frame))


@pytest.mark.parametrize("from_hz,to_hz", [(48_000, 16_000), (44_100, 16_000), (8_000, 16_000), (16_000, 16_000)])
def test_frames_equal_a_plain_convolution(spark, from_hz, to_hz):
    rng = random.Random(from_hz)
    sessions = {f"s{k}": [rng.gauss(0, 1) for _ in range(n)] for k, n in enumerate((0, 1, 3, 40, 700, 1500))}
    rows = []
    for s, x in sessions.items():
        at = seq = 0
        while at < len(x):
            n = rng.choice([1, 7, 100, 0])
            rows.append((s, seq, x[at : at + n]))
            at, seq = at + n, seq + 1
    df = spark.createDataFrame(rows, "session string, seq long, samples array<double>").repartition(4)
    for at_once, delay in ((1, None), (3, 0), (64, 5)):
        late = delay_of(from_hz, to_hz) if delay is None else delay
        got = {}
        for r in sorted(resampled_frames(df, from_hz, to_hz, frame=20, delay=delay, frames_at_once=at_once).collect(), key=lambda r: (r.session, r.frame)):
            assert r.frame == len(got.setdefault(r.session, [])) // 20
            got[r.session] += r.samples
        for s, x in sessions.items():
            want = plain(x, from_hz, to_hz, 20, late)
            assert len(got.get(s, [])) == len(want) and np.allclose(got.get(s, []), want, atol=1e-12), s


def test_a_tone_keeps_its_shape():
    t = np.arange(4800) / 48_000
    y = Filter(48_000, 16_000).values(np.sin(2 * np.pi * 1000 * t), 0, 0, 1600)
    assert np.abs(y - np.sin(2 * np.pi * 1000 * np.arange(1600) / 16_000))[50:-50].max() < 1e-3
    assert np.abs(Filter(48_000, 16_000).values(np.sin(2 * np.pi * 12_000 * t), 0, 0, 1600))[50:-50].max() < 1e-2  # beyond half the rate


def test_a_line_equals_the_whole_in_any_chunks():
    rng = np.random.default_rng(4)
    for from_hz in (48_000, 44_100, 8_000):
        x = rng.standard_normal(2500)
        want = plain(x, from_hz, 16_000, 30, 11)
        for size in (1, 17, 400, 2500):
            line, out, state = None, [], None
            for at in range(0, len(x), size):
                line = Line(from_hz, frame=30, delay=11, state=state)
                out += line.push(x[at : at + size])
                state = line.state
                assert len(state[0]) <= 2 * line.filter.reach + size + 2
            out += line.finish()
            assert np.allclose(np.concatenate(out), want, atol=1e-12)
            assert line.finish() == []  # nothing of it is left for the next session


def test_stream_equals_batch_and_sessions_do_not_leak(spark, tmp_path):
    rng = random.Random(6)
    data = {s: [[rng.gauss(0, 1) for _ in range(rng.choice([5, 60, 200]))] for _ in range(6)] for s in ("a", "b")}
    for k in range(6):
        spark.createDataFrame([(s, k, data[s][k], k == 5) for s in data], "session string, seq long, samples array<double>, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("session string, seq long, samples array<double>, last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = resampled_stream(source, 48_000, frame=16, delay=3).writeStream.format("memory").queryName("resampled").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    got = {}
    for r in sorted(spark.table("resampled").collect(), key=lambda r: (r.session, r.frame)):
        got.setdefault(r.session, []).extend(r.samples)
    for s in data:
        want = plain([v for part in data[s] for v in part], 48_000, 16_000, 16, 3)
        assert np.allclose(got[s], want, atol=1e-12)
