import random

from voxloom.operators.temporal import as_of

LEFT, RIGHT = "id int, key string, t long", "key string, t long, value int, name string"


def brute(left, right):
    out = []
    for i, k, t in left:
        known = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        best = max(known, key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3] or "")) if known else (None,) * 4
        out.append((i, k, t, best[2], best[3], best[1]))
    return sorted(out, key=str)


def test_as_of_equals_a_search_of_all_rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that keys lie in several ranges
    try:
        for seed in range(3):
            rng = random.Random(seed)
            key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", "c", None])
            left = [(i, key(), rng.choice([None, *range(200)])) for i in range(400)]
            right = [(key(), rng.choice([None, *range(0, 200, 7 * seed + 1)]), rng.choice([None, 1, 2, 3]), rng.choice("xyz")) for _ in range(150)]
            left += left[:30]
            right += right[:10]
            df = as_of(spark.createDataFrame(left, LEFT).repartition(5), spark.createDataFrame(right, RIGHT).repartition(3), "key", "t")
            assert df.columns == ["id", "key", "t", "value", "name", "found_t"]
            assert sorted((tuple(r) for r in df.collect()), key=str) == brute(left, right)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_sides(spark):
    left, right = spark.createDataFrame([(1, "a", 5)], LEFT), spark.createDataFrame([("a", 5, 1, "x")], RIGHT)
    assert as_of(left.limit(0), right, "key", "t").count() == 0
    assert as_of(left, right.limit(0), "key", "t").first().value is None
    assert as_of(left, right, "key", "t", prefix="r_").first().r_value == 1
