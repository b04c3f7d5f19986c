import random

import duckdb
from pyspark.sql import functions as F

from voxloom.operators.metrics import Speed, Throttle, download_speed, throttled
from voxloom.operators.segments import packed
from voxloom.plans import streams
from voxloom.streaming.coordinator import Coordinator, coordinated


def hot(rng, n, keys=6):
    """Half of all rows are of one key."""
    return ["hot" if rng.random() < 0.5 else f"k{rng.randrange(keys)}" for _ in range(n)]


def test_a_hot_key_is_spread_over_tasks(spark):
    rows = [(k, i) for i, k in enumerate(hot(random.Random(1), 4000))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows into one task
    try:
        found = packed(spark.createDataFrame(rows, "key string, t long").repartition(5), "key", ["t"], 100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.filter("key = 'hot'").select("part").distinct().count() > 2
    of = {}
    for r in sorted(found.collect(), key=lambda r: (r.key, r.part, r.seq)):
        assert len(r.t) <= 100
        of.setdefault(r.key, []).extend(r.t)
    assert of == {k: [i for key, i in rows if key == k] for k in of} and sum(map(len, of.values())) == 4000


def test_throttle_equals_one_event_after_the_other(spark):
    for seed in range(3):
        rng, rows, clock = random.Random(seed), [], {}
        for k in hot(rng, 1500):
            clock[k] = clock.get(k, 0) + rng.choice([0, 1, 5, 5, 30, 99, 100, 250] if seed else [0, 1, 1, 2])
            rows.append((k, clock[k], rng.choice([1, 5, 10]), rng.choice([0, 10, 10, 50])))
        rows += rows[:50] + [(None, 1, 1, 1)]
        want = []
        for key in clock:
            gate = Throttle(100)
            want += [r for r in sorted(r for r in rows if r[0] == key) if gate.feed(*r[1:])]
        df = spark.createDataFrame(rows, "key string, t_ms long, done long, total long").repartition(4)
        for size in (7, 100, 5000):
            assert sorted(tuple(r) for r in throttled(df, size=size).collect()) == sorted(want)


def test_speed_equals_one_event_after_the_other(spark):
    for seed in range(3):
        rng, rows, clock = random.Random(seed), [], {}
        for k in hot(rng, 1500):
            t, d = clock.get(k, (0.0, 0))
            clock[k] = t + rng.choice([0.0, 0.1, 0.25, 0.5, 0.5000001, 3.0] if seed else [0.01, 0.02]), max(0, d + rng.choice([0, 0, 1 << 20, -(1 << 19), 12345]))
            rows.append((k, *clock[k]))
        df = spark.createDataFrame(rows, "model_id string, t double, downloaded long").repartition(4)
        for size in (7, 5000):
            got = {r.model_id: (r.speed, r.samples) for r in download_speed(df, size=size).collect()}
            assert set(got) == set(clock)
            for key in clock:
                meter = Speed()
                for r in sorted(r for r in rows if r[0] == key):
                    meter.feed(float(r[1]), float(r[2]))
                assert got[key][1] == meter.samples and abs(got[key][0] - meter.speed) <= 1e-12 * max(1, meter.speed)


def test_coordinator_equals_one_event_after_the_other(spark):
    for seed in range(2):
        rng, rows, clock = random.Random(seed), [], {}
        for n, k in enumerate(hot(rng, 700, 3)):
            clock[k] = clock.get(k, 0) + rng.choice([0, 10, 20, 40, 60, 200, 400])
            rows.append((k, n, clock[k], rng.choice(["press", "press", "release", "release", "finished", "cancel", "denied"]), rng.choice("ab"), rng.choice(["hold", "toggle", "hold_or_toggle", None]), rng.choice([300, 100, None]), rng.choice([True, False, None])))
        df = spark.createDataFrame(rows, "key string, seq long, t_ms long, kind string, binding string, mode string, hold_ms long, external boolean")
        want = []
        for key in clock:
            machine = Coordinator()
            for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
                machine.feed(r[2], r[3], r[4], r[5] or "hold_or_toggle", 300 if r[6] is None else r[6], bool(r[7]))
            machine.advance(1 << 62)
            want += [(key, *e) for e in machine.effects]
        for size in (9, 5000):
            assert sorted(tuple(r) for r in coordinated(df.repartition(3), size=size).collect()) == sorted(want)


def test_empty(spark):
    none = spark.createDataFrame([], "key string, t_ms long, done long, total long, model_id string, t double, downloaded long, kind string, seq long")
    assert throttled(none).count() == download_speed(none).count() == coordinated(none.select("key", "seq", "t_ms", F.lit("press").alias("kind"))).count() == 0


def test_throttled_events_of_one_time_and_of_none(spark):
    """In the order of ties, nulls last; events without a time behind all others, let through if complete or the first of their key."""
    rng = random.Random(5)
    rows = [(k, None if k == "k0" or rng.random() < 0.2 else rng.randrange(40) * 50 - 900, rng.choice([1, 10]), 10, rng.choice([None, *range(99)])) for k in hot(rng, 900, 3)]
    rows += [("only", None, 1, 10, 7), ("only", None, 1, 10, 8)]
    want = []
    for key in {r[0] for r in rows}:
        gate, first = Throttle(100), True
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or 0, r[4] is None, r[4] or 0, r[2])):
            if gate.feed(*r[1:4]) if r[1] is not None else first or r[2] == 10:
                want.append(r[:4])
            first = False
    df = spark.createDataFrame(rows, "key string, t_ms long, done long, total long, seq long").repartition(4)
    for size in (7, 5000):
        assert sorted(map(str, map(tuple, throttled(df, size=size, ties=("seq", "done")).collect()))) == sorted(map(str, want))


def test_throttle_query_equals_its_sql_on_odd_events(spark, tmp_path):
    """the order within a second, times and ids and users that are null, times before 1970."""
    duck = duckdb.connect()
    duck.execute(f"""COPY (SELECT CASE WHEN i % 23 > 0 THEN i * 7919 % 3001 - 500 END AS event_id, CASE WHEN i % 31 > 0 AND i % 6 < 5 THEN make_timestamp((CASE WHEN i % 3 = 0 THEN -5000000000 ELSE 1704067200000000 END + i * 104729 % 97 * 40000000000 + i % 7 * 150000)::BIGINT) END AS ts,
        CASE WHEN i % 37 = 0 THEN NULL WHEN i % 2 = 0 THEN 3 ELSE i % 12 END AS user_id FROM range(3000) AS r(i)) TO '{tmp_path}/events.parquet'""")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = streams.QUERIES["h3_throttled"](spark, str(tmp_path)).select("key", "t_ms").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, duck.execute(streams.ORACLES["h3_throttled"]).fetchall()))
