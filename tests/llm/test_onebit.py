import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import onebit

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, asks):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q, v in rows:
        if asks(q):
            scores = []
            for i, w in rows:
                if i != q and len(w) == len(v):
                    s = 0.0
                    for x, y in zip(v, w, strict=True):
                        s += x * y
                    scores.append((-s, i))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(spark, rows, k, **kw):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS query", "2 AS score", "3 AS vector")
    return sorted(tuple(r) for r in onebit.nearest(df, F.col("vec_id") % 5 == 0, k=k, **kw).collect())


@pytest.mark.parametrize("seed,dim", [(0, 1), (1, 3), (2, 64), (3, 300)])
def test_against_all_products(spark, seed, dim):
    rng = random.Random(seed)
    vector = lambda: [rng.gauss(0, 1) * 10 ** rng.randint(-2, 2) for _ in range(dim)]
    rows = [(i, vector()) for i in range(300)]
    hot = vector()
    rows += [(1000 + i, hot) for i in range(150)] + [(2000 + i, [x + rng.gauss(0, 0.01) for x in hot]) for i in range(100)]
    rows += rows[:10] + [(5, vector())]
    assert found(spark, rows, 7, chunk=64, block=20) == brute(rows, 7, lambda q: q % 5 == 0)


def test_rows_without_a_direction_take_no_part_and_dimensions_stay_apart(spark):
    nan, inf = float("nan"), float("inf")
    good = [(-5, [1.0, 0.0]), (0, [1.0, 1.0]), (1, [0.0, 2.0]), (2, [1e200, -1e-200]), (3, [-1.0, -1.0]), (10, [1.0]), (11, [2.0]), (15, [1.0, 2.0, 3.0]), (20, [5e-324, 0.0])]
    bad = [(25, None), (30, []), (35, [0.0, -0.0]), (40, [1.0, None]), (45, [nan, 1.0]), (50, [inf, 1.0]), (None, [1.0, 1.0])]
    assert found(spark, good + bad, 3) == brute(good, 3, lambda q: q % 5 == 0)


def test_ties_go_to_the_smaller_id_and_few_candidates_are_all_told(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [1.0, 1.0]) for i in range(12)]
    got = found(spark, rows, 4)
    assert [r[2] for r in got if r[0] == 5] == [0, 1, 2, 3]
    assert len([r for r in found(spark, rows, 50) if r[0] == 0]) == 11
    assert found(spark, [(0, [1.0])], 4) == [] and found(spark, [], 4) == []


def test_bound_holds_and_estimates_are_unbiased():
    rng = np.random.default_rng(5)
    vectors, queries = rng.standard_normal((400, 64)), rng.standard_normal((200, 64))
    codes, length, cosines = onebit.encode(vectors)
    assert codes.shape == (400, 32) and np.allclose(length, np.linalg.norm(vectors, axis=1))
    norms, turned = onebit.rotated(queries, onebit.BITS, onebit.SEED)
    estimate, error = onebit.estimates(codes, cosines, turned, 4.0)
    off = estimate - (queries / norms[:, None]) @ (vectors / length[:, None]).T
    assert (np.abs(off) <= error).mean() > 0.9995 and abs(off.mean()) < 0.002 and off.std() < 0.06


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
@pytest.mark.parametrize("sigmas,least", [(onebit.SIGMAS, 0.999), (2.0, 0.9)])
def test_recall_on_the_given_vectors(spark, sigmas, least):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.toPandas()
    vectors, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    want = set()
    for at in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[at]
        score[at] = -np.inf
        want |= {(ids[at], i) for i in ids[np.lexsort((ids, -score))[:20]]}
    got = {(r.query_id, r.vec_id) for r in onebit.nearest(df, F.col("vec_id") % 20 == 0, sigmas=sigmas).collect()}
    assert len(got & want) >= least * len(want)
