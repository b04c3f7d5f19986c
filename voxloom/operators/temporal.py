"""Joins in time: what was known of a key when something happened (§2.12, beside G2 and S12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import written


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, prefix: str = "") -> DataFrame:
    """Rows of left with the columns of the newest row of right of their key at or before their time (nulls if there is none); these columns get the prefix.

    Of rows of right at one time the greatest counts, column by column in their order;
    rows with a null key or time match nothing, and rows of left stay as often as they come.

    Both sides are dealt by ranges of (key, time), so a key with many rows lies in many
    tasks: each range fills in what it has itself, and what it begins with comes from the ranges before,
    of which only the last row of each key is looked at.
    """
    columns = [c for c in right.columns if c not in (key, time)]
    kind = dict(left.dtypes)[key]
    told = F.struct(F.col(time).alias("_time"), *columns)
    ones = left.select(F.col(key).alias("_key"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    others = right.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).cast(kind).alias("_key"), F.col(time).alias("_t"), F.lit(0).alias("_side"), told.alias("_right"))
    rows = ones.unionByName(others, allowMissingColumns=True).withColumn("_own", F.monotonically_increasing_id())
    order = ("_key", "_t", "_side", "_right", "_own")  # rows of right come before those of left at their time
    rows = rows.repartitionByRange("_key", "_t", "_side", "_own").sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    rows = written(rows.drop("_own"), "as-of")

    known = F.when(F.col("_key").isNotNull() & F.col("_t").isNotNull(), F.col("_right"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter("_side = 0").groupBy("_key", "_part").agg(F.max(F.struct("_t", "_right")).alias("_last"))
    ranges = rows.select("_key", "_part").distinct().join(last, ["_key", "_part"], "left")  # a row for each key and range
    carried = ranges.select("_key", "_part", F.last("_last", ignorenulls=True).over(before)["_right"].alias("_carried"))
    within = Window.partitionBy("_key", "_part").orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_here", F.last(known, ignorenulls=True).over(within)).filter("_side = 1")
    found = found.join(carried, ["_key", "_part"], "left").withColumn("_found", F.when(F.col("_t").isNotNull(), F.coalesce("_here", "_carried")))
    return found.select("_left.*", *[F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in columns], F.col("_found._time").alias(f"{prefix}{time}" if prefix else f"found_{time}"))
