import random
import struct

import numpy as np
import pytest

from voxloom.operators import metrics, signal, vad
from voxloom.sources import media
from voxloom.streaming import coordinator
from voxloom.streaming.vad import Smoother, download_speed_stream, smoothed_stream, throttled_stream


def test_smoothing_against_the_sequential_model(spark):
    rng = random.Random(1)
    for p, h, o in ((3, 2, 2), (0, 0, 1), (5, 1, 3), (15, 15, 2), (6, 0, 2)):
        rows, want = [], {}
        for s in range(80):
            smoother = Smoother(p, h, o)
            for i in range(rng.randint(0, 50)):
                v = rng.random() < rng.choice([0.2, 0.5, 0.8])
                rows.append((s, i, v))
                for j in smoother.push(i, v):
                    want[s, j] = want.get((s, j), 0) + 1
        got = {(r.session, r.i): r.emitted for r in vad.smoothed(spark.createDataFrame(rows, "session int, i long, voiced boolean"), p, h, o).collect()}
        assert got == want


def test_tail_reports(spark):
    frames = [(1, 0, False), (1, 1, True), *[(2, i, i < 2) for i in range(6)]]
    out = {r.session: r for r in vad.tail_report(spark.createDataFrame(frames, "session int, i long, voiced boolean"), 3, 2, 2).collect()}
    assert (out[1].withheld, out[1].withheld_voiced, out[1].in_speech) == (2, 1, False)
    assert (out[2].withheld, out[2].withheld_voiced) == (2, 0)


@pytest.mark.parametrize(("frame", "want"), [(480, (15, 15, 2)), (256, (29, 29, 4))])
def test_frames(frame, want):
    assert vad.policy_frames("offline", frame) == want
    assert vad.policy_frames("streaming", frame)[1] == {480: 55, 256: 104}[frame]


def test_downmix_and_frames(spark):
    df = spark.createDataFrame([([1.0, 3.0, -1.0, 1.0, 9.0], 2, None), ([1.0, 3.0, -1.0, 1.0], 2, 1), ([1.0, 3.0], 2, 5), ([5.0], 1, None), ([], 2, None)], "x array<double>, n int, k int")
    assert [r.y for r in df.select(vad.downmixed("x", "n", "k").alias("y")).collect()] == [[2.0, 0.0], [3.0, 1.0], [2.0], [5.0], []]
    assert [r.y for r in df.select(vad.framed("x", 4).alias("y")).collect()][:2] == [[[1, 3, -1, 1], [9, 0, 0, 0]], [[1, 3, -1, 1]]]
    assert [len(r.y) for r in df.select(vad.padded_clip("x").alias("y")).collect()] == [20000, 20000, 20000, 20000, 0]


def test_streamed_smoothing_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(s, i, rng.random() < 0.5) for s in range(5) for i in range(40)]
    for b in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 10 == b], "session int, i long, voiced boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session int, i long, voiced boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = smoothed_stream(stream, 3, 2, 2).writeStream.format("memory").queryName("smoothed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {}
    for r in spark.table("smoothed").collect():
        got[r.session, r.i] = got.get((r.session, r.i), 0) + 1
    assert got == {(r.session, r.i): r.emitted for r in vad.smoothed(spark.createDataFrame(rows, "session int, i long, voiced boolean"), 3, 2, 2).collect()}


def test_streamed_metrics_equal_batch(spark, tmp_path):
    rows = [(k % 2, k * 40, k, 50) for k in range(50)]
    spark.createDataFrame(rows, "key int, t_ms long, done long, total long").coalesce(1).write.parquet(str(tmp_path / "t"))
    read = lambda: spark.readStream.schema("key int, t_ms long, done long, total long").parquet(str(tmp_path / "t"))
    q = throttled_stream(read(), 100).writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = metrics.throttled(spark.read.parquet(str(tmp_path / "t")), "key", 100)
    assert sorted(map(tuple, spark.table("throttled").collect())) == sorted(map(tuple, batch.collect()))
    speeds = read().selectExpr("key AS model_id", "t_ms / 100.0D AS t", "done * 1000000 AS downloaded")
    q = download_speed_stream(speeds).writeStream.format("memory").outputMode("update").queryName("speeds").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = metrics.download_speed(spark.read.parquet(str(tmp_path / "t")).selectExpr("key AS model_id", "t_ms / 100.0D AS t", "done * 1000000 AS downloaded"))
    assert {r.model_id: round(r.speed, 9) for r in spark.table("speeds").collect()} == {r.model_id: round(r.speed, 9) for r in batch.collect()}


CASES = [
    # a hold: press, release after the threshold, grace over
    ([(0, "press"), (400, "release")], [(0, "start"), (450, "stop")]),
    # a tap locks; the next press stops
    ([(0, "press"), (100, "release"), (900, "press")], [(0, "start"), (900, "stop")]),
    # auto-repeat: a release taken back by a press in its grace time
    ([(0, "press"), (400, "release"), (420, "press"), (800, "release")], [(0, "start"), (850, "stop")]),
    # debounced double press while locked
    ([(0, "press"), (100, "release"), (900, "press"), (910, "press"), (2000, "finished")], [(0, "start"), (900, "stop")]),
    # a press while busy is remembered and starts when the pipeline is done
    ([(0, "press"), (400, "release"), (600, "press"), (900, "finished")], [(0, "start"), (450, "stop"), (900, "start")]),
    # held and let go while busy: forgotten
    ([(0, "press"), (400, "release"), (600, "press"), (1000, "release"), (2000, "finished")], [(0, "start"), (450, "stop")]),
    # tapped while busy: starts locked
    ([(0, "press"), (400, "release"), (600, "press"), (700, "release"), (2000, "finished"), (3000, "press")], [(0, "start"), (450, "stop"), (2000, "start"), (3000, "stop")]),
    # cancel gives up recording and what is remembered
    ([(0, "press"), (100, "cancel"), (500, "press")], [(0, "start"), (500, "start")]),
    # a start that the executor denies
    ([(0, "press"), (5, "denied"), (500, "press")], [(0, "start"), (500, "start")]),
]


@pytest.mark.parametrize(("events", "want"), CASES)
def test_coordinator(events, want):
    machine = coordinator.Coordinator()
    for t, kind in events:
        machine = restored(machine)
        machine.feed(t, kind, "b")
    machine.advance(10**9)
    assert [(t, e) for t, e, _ in machine.effects] == want


def restored(machine):
    made = coordinator.Coordinator(machine.dumped())
    made.effects = machine.effects
    return made


def test_coordinator_modes():
    def run(mode, *events, external=False):
        machine = coordinator.Coordinator()
        for t, kind in events:
            machine.feed(t, kind, "b", mode, 300, external)
        machine.advance(10**9)
        return [(t, e) for t, e, _ in machine.effects]

    assert run("toggle", (0, "press"), (50, "release"), (100, "press")) == [(0, "start"), (100, "stop")]
    assert run("push_to_talk", (0, "press"), (10, "release")) == [(0, "start"), (60, "stop")]
    assert run("toggle", (0, "press"), (10, "press")) == [(0, "start")]
    assert run("toggle", (0, "press"), (10, "press"), external=True) == [(0, "start"), (10, "stop")]


def test_coordinator_in_groups(spark):
    events = [(f"k{k}", n, t, kind, "b") for k, (case, _) in enumerate(CASES) for n, (t, kind) in enumerate(case)]
    df = coordinator.edges_of(spark.createDataFrame(events, "key string, seq long, t_ms long, kind string, binding string"))
    out = {}
    for r in coordinator.coordinated(df).collect():
        out.setdefault(r.key, []).append((r.t_ms, r.effect))
    assert {k: sorted(v) for k, v in out.items()} == {f"k{k}": want for k, (_, want) in enumerate(CASES)}


def header(entries, version=3):
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
    out = b"GGUF" + struct.pack("<IQQ", version, 0, len(entries))
    for key, kind, value in entries:
        out += text(key) + struct.pack("<I", kind)
        if kind == 8:
            out += text(value)
        elif kind == 9:
            out += struct.pack("<IQ", 8, len(value)) + b"".join(map(text, value))
        else:
            out += struct.pack("<" + media.SCALARS[kind], value)
    return out


def test_headers(spark):
    good = header([("general.name", 8, "N"), ("x", 9, ["a"] * 9), ("general.languages", 9, ["en", "de"]), ("stt.capability.translate", 4, 1), ("stt.capability.streaming", 2, 1), ("general.architecture", 8, "whisper")])
    deep = header([("pad", 8, "x" * 300_000), ("general.name", 8, "Deep")])
    files = spark.createDataFrame([("good", good), ("deep", deep), ("cut", good[:60]), ("bad", b"ZZZZ" + good[4:]), ("old", header([], 1)), ("none", None)], "path string, content binary")
    out = {r.path: r for r in media.probed(files).collect()}
    assert (out["good"].name, out["good"].arch, out["good"].languages, out["good"].translate, out["good"].streaming, out["good"].lang_detect) == ("N", "whisper", ["en", "de"], True, None, None)
    assert out["deep"].name == "Deep" and out["good"].error is None
    assert all(out[p].error and out[p].name is None for p in ("cut", "bad", "old", "none"))


def test_wav_round_trip(spark):
    x = [0.0, 0.5, -1.0, 1.0, 2.0, -3.0]
    df = spark.createDataFrame([("a", x)], "path string, x array<float>").select("path", media.encoded_wav("x").alias("content"))
    r = media.recordings(df).first()
    assert (r.rate, r.channels, r.bits) == (16000, 1, 16)
    assert np.allclose(r.samples, [0, 16383 / 32767, -1, 1, 1, -32768 / 32767], atol=1e-6)
    assert media.recordings(spark.createDataFrame([("b", b"no")], "path string, content binary")).first().error


def test_signal():
    assert signal.levels(np.zeros(10), 16) is None
    assert (signal.levels(np.zeros(512), 512) == 0).all()
    tone = signal.levels(np.sin(2 * np.pi * 1000 * np.arange(512) / 16000), 512)
    assert tone.argmax() == next(k for k, (a, b) in enumerate(signal.bucket_bins(512, 16000)) if a <= 32 < b) and 0 <= tone.min() and tone.max() <= 1
    assert [len(signal.resampled(np.ones(n), hz)) for n, hz in ((4096, 48000), (4096, 44100), (4396, 48000))] == [1920, 1920, 1920]
    assert len(signal.resampled(np.ones(0), 48000)) == 0 and len(signal.resampled(np.ones(481), 16000)) == 960
