"""Numbering all rows of a table in an order, without a window that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.session import written

_LOW = (1 << 33) - 1  # bits of monotonically_increasing_id that count within a partition


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place (from 1) in the order.

    Rows are dealt by ranges of the whole order, whose bounds Spark samples, and
    numbered within each; a range begins behind the counts of those before it, the only thing that
    the driver holds. Rows that the order can't tell apart share a range, so it should
    end in a key where many are alike.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged.withColumns({"_range": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND(_LOW)}).drop("_at"), "placed")
    starts, before = [], 0
    for r in sorted(ranged.groupBy("_range").count().collect()):  # a row for each range
        starts.append((int(r[0]), before))
        before += int(r[1])
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range long, _start long"))
    return ranged.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_nth") + 1).drop("_range", "_nth", "_start")
