import random
import zlib

import pytest

from voxloom.llm import sharding


def least_capacity(rows, shards):
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(-(1 << 62) if i is None else i)
    sizes = [sum(len((t or "").encode()) + 1 for _ in groups[t]) for t in sorted(groups, key=lambda t: min(groups[t]))]

    def needed(capacity):
        n, held = 1, 0
        for x in sizes:
            if held + x > capacity:
                n, held = n + 1, 0
            held += x
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("n", [1, 5, 60, 300])
def test_smallest_capacity_and_gapless_slots(spark, n):
    rng = random.Random(n)
    hot = "hot text" * 3
    rows = [(i * 3 if rng.random() > 0.02 else None, rng.choice([None, "", "bé" * rng.randint(1, 50), hot, hot] + [f"x{i}" * rng.randint(1, 9)] * 9)) for i in range(n)]
    rows += rows[: n // 10]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text").selectExpr("*", "'a' AS shard", "1 AS key")
    out = sharding.contiguous_shards(docs, per_range=16, most_parts=5).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes, slots = {}, {}
    for r in out:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(sizes.values()) == least_capacity(rows, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    of_text = {}
    for r in out:
        of_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for (crc, size), s in of_text.items() if size > 1)


def test_empty(spark):
    assert sharding.contiguous_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
