import random

from pyspark.sql import functions as F

from voxloom.operators.ranking import placed


def test_places_equal_a_sort(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1.0, 1.0, 1.0, 2.5, rng.random(), None]), rng.choice("aab")) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, score double, name string").repartition(7)
    got = placed(df, [F.desc_nulls_last("score"), F.asc("name"), F.asc("id")])
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    assert [(r.id, r.place) for r in sorted(got.collect(), key=lambda r: r.place)] == [(r[0], k) for k, r in enumerate(order, 1)]
    assert got.columns == ["id", "score", "name", "place"]


def test_ties_and_empty_tables(spark):
    same = spark.range(500).select(F.lit(1).alias("x"))
    assert sorted(r.place for r in placed(same, [F.asc("x")]).collect()) == list(range(1, 501))
    assert placed(same.limit(0), [F.asc("x")]).count() == 0
