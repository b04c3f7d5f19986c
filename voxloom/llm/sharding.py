"""Operator 7: sharding by a minimax contiguous partition.

Groups (all rows of one text) are atomic and ordered by their least doc_id. The
smallest capacity for which a greedy pass needs no more than the given number of
shards is found by binary search over the groups' running sizes; the groups are
then cut where that pass ends each shard, so the largest shard is as small as
contiguous shards of whole groups can be.

The running sizes stay distributed. Rows are cut into at most `most_parts` ranges
of doc_id with about as many rows each, wherever the ids lie. The driver holds one
sum for each range of groups (by their first doc_id); ends of shards are first
bounded by these. In the few ranges in which the answer depends on single groups,
running sizes are fetched, or asked for one by one where a range has more than
`most_fetched` groups. A group may hold a large part of all rows: its rows are
counted and numbered by ranges of doc_id, never by one task.

Defined cases: a null text has size 1, the CRC of an empty text, and forms a
group with the other null texts; rows of one doc_id are numbered by size and
CRC; a null doc_id comes first; with fewer groups than shards the last shards
are empty; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import LEAST, cut_points, written
from voxloom.session import on_workers


def greedy_ends(capacity: int, shards: int, total: int, end_of) -> list[int] | None:
    """Running sizes at the ends of the shards that a greedy pass fills, None if they don't hold all. end_of(x): the largest group end <= x."""
    ends, at = [], 0
    for _ in range(shards):
        at = total if at + capacity >= total else end_of(at + capacity)
        ends.append(at)
    return ends if at == total else None


def minimax_ends(total: int, largest: int, shards: int, coarse: np.ndarray, fetch, ask=None) -> list[int]:
    """Ends of the shards of the smallest capacity. coarse: running sizes at the ends of ranges; fetch(k): those of the groups of range k, or None; then ask(k, x): the largest up to x of these, or None."""
    fine: dict[int, np.ndarray | None] = {}

    def exact(x: int) -> int:
        k = int(np.searchsorted(coarse, x, "right"))  # the range in which the group that ends after x lies
        if k >= len(coarse):
            return int(coarse[-1])
        if k not in fine:
            fine[k] = fetch(k)
        if fine[k] is None:
            end = ask(k, x)
            return end if end is not None else int(coarse[k - 1]) if k else 0
        at = int(np.searchsorted(fine[k], x, "right"))
        return int(fine[k][at - 1]) if at else int(coarse[k - 1]) if k else 0

    def least(x: int) -> int:
        k = int(np.searchsorted(coarse, x, "right"))
        return int(coarse[k - 1]) if k else 0

    low, high = max(largest, -(-total // shards)), total
    while low < high:
        middle = (low + high) // 2
        if greedy_ends(middle, shards, total, least):
            fits = True
        else:
            fits = greedy_ends(middle, shards, total, lambda x: x) is not None and greedy_ends(middle, shards, total, exact) is not None
        low, high = (low, middle) if fits else (middle + 1, high)
    return greedy_ends(low, shards, total, exact) or [0] * (shards - 1) + [total]


def contiguous_shards(docs: DataFrame, *, shards: int = 8, per_range: int = 4096, most_parts: int = 20_000, most_fetched: int = 1 << 20) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs (doc_id, text)."""
    on_workers(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("crc"),
        F.coalesce(F.sha2("text", 256), F.lit("null")).alias("key"),
    )
    count = rows.count()
    empty = rows.limit(0).select(F.col("_id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    if not count:
        return empty
    bounds = docs.sparkSession.sparkContext.broadcast(cut_points(rows, "_id", count, min(most_parts, -(-count // per_range))))  # 8 bytes a range

    @F.pandas_udf("long")
    def ranged(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, ids.to_numpy(np.int64), "right").astype(np.int64))

    # rows of a group by ranges of doc_id, then running over its ranges
    counted = rows.withColumn("range", ranged("_id")).groupBy("key", "range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("_id").alias("first"))
    of_key = Window.partitionBy("key")
    ranges = counted.select(
        "key",
        "range",
        F.coalesce(F.sum("n").over(of_key.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.row_number().over(of_key.orderBy("range")).alias("nth"),
        F.min("first").over(of_key).alias("first"),
        F.sum("bytes").over(of_key).alias("bytes"),
        F.sum("n").over(of_key).alias("n"),
    )
    ranges = written(ranges.withColumn("part", ranged("first")), "shard-ranges")

    # groups with the running sizes and counts of what comes before them
    groups = ranges.filter("nth = 1")
    parts = sorted(groups.groupBy("part").agg(F.sum("bytes"), F.sum("n"), F.max("bytes"), F.count("*")).collect())
    offsets = np.cumsum([[0, 0], *([p[1], p[2]] for p in parts)], axis=0)
    starts = docs.sparkSession.createDataFrame([(int(p[0]), int(a), int(b)) for p, (a, b) in zip(parts, offsets, strict=False)], "part long, part_bytes long, part_n long")  # most_parts rows
    in_part = Window.partitionBy("part").orderBy("first", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.join(F.broadcast(starts), "part").select(
        "key",
        "part",
        "bytes",
        (F.coalesce(F.sum("bytes").over(in_part), F.lit(0)) + F.col("part_bytes")).alias("from_byte"),
        (F.coalesce(F.sum("n").over(in_part), F.lit(0)) + F.col("part_n")).alias("from_row"),
    )
    placed = written(placed, "shard-groups")

    ends_of = lambda k: placed.filter(F.col("part") == int(parts[k][0])).select((F.col("from_byte") + F.col("bytes")).alias("end"))

    def fetch(k: int) -> np.ndarray | None:
        return np.sort(ends_of(k).toPandas()["end"].to_numpy(np.int64)) if parts[k][4] <= most_fetched else None

    def ask(k: int, x: int) -> int | None:
        return ends_of(k).filter(F.col("end") <= x).agg(F.max("end")).first()[0]

    total = int(offsets[-1][0])
    ends = minimax_ends(total, max(int(p[3]) for p in parts), shards, offsets[1:, 0], fetch, ask)
    cut = sorted(set(ends[:-1]) - {total})
    heads = {int(r.from_byte): int(r.from_row) for r in placed.filter(F.col("from_byte").isin([0, *cut])).select("from_byte", "from_row").collect()}  # a row for each shard
    shard, base = F.lit(0), F.lit(0).cast("long")
    for k, end in enumerate(cut, 1):
        shard = F.when(F.col("from_byte") >= end, k).otherwise(shard)
        base = F.when(F.col("from_byte") >= end, F.lit(heads[end]).cast("long")).otherwise(base)
    placed = placed.select("key", shard.alias("shard"), (F.col("from_row") - base).alias("slot"))

    numbered = rows.withColumn("range", ranged("_id")).join(ranges.select("key", "range", "before").join(placed, "key"), ["key", "range"])
    in_range = Window.partitionBy("key", "range").orderBy("_id", "size", "crc")
    return numbered.select(
        F.when(F.col("_id") != LEAST, F.col("_id")).alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("slot") + F.col("before") + F.row_number().over(in_range) - 1).alias("slot"),
    )
