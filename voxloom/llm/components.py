"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import gone, hot_join, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each end of edges (a long, b long) reaches. Nulls and loops are no edges.

    Every step is an aggregation and a join on nodes, in which the edges of nodes
    that hold much of them stay where they are; steps are cut by tables in the shared
    folder, and their number grows with the logarithm of the longest path.
    """
    u, v = F.col("u"), F.col("v")
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter((u != v) & F.col("v").isNotNull()).distinct(), "edges")
    told, before = None, None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == told:
            break
        told = tuple(seen)
        gone(before)
        both = now.select("u", "v").unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_rows"))
        large = hot_join(both, least, ["u"], 2 * seen[0]).filter(v > u).select(v.alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        before, now = now, written(joined.select("u", F.col("m").alias("v")).unionByName(joined.filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))).distinct(), "edges")
    gone(before)
    return now.select(u.alias("node"), v.alias("component")).unionByName(now.select(v.alias("node"), v.alias("component"))).distinct()
