"""Joins, ranges and samples that the operators share, against plain versions."""

import random

import numpy as np
import pytest

from voxloom.llm import common, jaccard, langid, lmscore, quality, sharding


def test_joins_without_a_shuffle_of_all_rows(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(rng.choice([None, *range(500)]), f"t{k}") for k in range(900)], "k long, text string")
    ids = spark.createDataFrame([(i, i * 2) for i in rng.sample(range(700), 200)], "k long, v long")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    for how in ("inner", "left", "left_anti"):
        want = key(docs.join(ids, "k", how))
        columns = docs.join(ids, "k", how).columns
        for most in (10**6, 0):
            assert key(common.join_ids(docs, "k", ids, how, most).select(*columns)) == want, (how, most)
    none = ids.limit(0)
    assert common.join_ids(docs, "k", none, "left_anti", 0).count() == 900 and common.join_ids(docs, "k", none, "inner", -1).count() == 0


def test_a_bitmap_never_denies_a_value(spark):
    ids = spark.range(5000).selectExpr("id * 7 - 9000 AS k")
    perhaps = common.perhaps_in(ids, "k", most_bits=1 << 17)
    rows = spark.range(-9000, 26000).select("id", perhaps("id").alias("p"))
    assert rows.join(ids, rows["id"] == ids["k"]).filter("NOT p").count() == 0
    assert rows.filter("p").count() < 10_000


def test_hot_keys_are_joined_whole(spark):
    left = spark.createDataFrame([(0 if k % 3 else k, k) for k in range(3000)], "k long, v long")
    right = left.groupBy("k").count().selectExpr("k", "k * 2 AS w", "count AS _rows")
    out = common.hot_join(left, right, ["k"], 3000, shares=16)
    assert sorted((r.k, r.v, r.w) for r in out.collect()) == sorted((0 if k % 3 else k, k, 0 if k % 3 else 2 * k) for k in range(3000))


def test_ranges_go_by_rows_not_by_values(spark):
    """One value far away leaves the ranges of the others even."""
    ids = spark.range(20_000).selectExpr("IF(id = 7, CAST(1e17 AS LONG), id) AS k")
    cuts = common.cut_points(ids, "k", 20_000, 10)
    where = np.bincount(np.searchsorted(cuts, np.array([r.k for r in ids.collect()]), "right"))
    assert len(cuts) == 10 and where[0] == 0 and where[1:].max() < 4000 and where[1:].min() > 800
    assert common.cut_points(ids.limit(0), "k", 0, 4).tolist() == []
    assert common.cut_points(ids.selectExpr("5L AS k"), "k", 20_000, 4).tolist() == [5]


def test_sharding_with_one_outlier_fetches_few_ends(spark):
    rows = [(k if k else 10**17, f"text {k} " + "x" * (k % 50)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.contiguous_shards(docs, per_range=100).collect()
    small = sharding.contiguous_shards(docs, per_range=100, most_fetched=10).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, small)) and len(out) == 3000
    sizes = np.bincount([r.shard for r in out], [r.size for r in out], minlength=8)
    assert sizes.max() <= sizes.sum() / 8 + max(len(t) + 1 for _, t in rows)
    assert {(r.shard, r.slot) for r in out} == {(s, k) for s in range(8) for k in range(sum(r.shard == s for r in out))}


def test_every_language_is_learned(spark):
    """Seventy languages (more than the 64 of old), each with its own letters."""
    rng = random.Random(2)
    rows = []
    for k in range(70):
        letters = "".join(chr(0x4E00 + 40 * k + j) for j in range(12))
        rows += [(1000 * k + i, "".join(rng.choice(letters + " ") for _ in range(60)) + letters[0], f"l{k:02}") for i in range(20)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=8).collect()
    truth = {i: x for i, _, x in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.99 and {r.lang_pred for r in out} == set(truth.values())


def test_language_decisions_equal_kernel_ridge_regression():
    """With every text a landmark, the decisions are those of ridge regression on the kernel's own features, texts taken a few at a time."""
    rng = random.Random(3)
    rows = [("".join(rng.choice("abcd " if k % 2 else "wxyz ") for _ in range(30)), "ab"[k % 2]) for k in range(24)]
    found = [langid.presence(t) for t, _ in rows]
    names, matrix = langid.train(found, [x for _, x in rows], landmarks=24, ridge=0.05, at_once=5)
    p = langid._dense(found, langid.BITS)
    kernel = (p @ p.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    good = values > 1e-6 * values.max()
    phi = np.hstack([kernel @ vectors[:, good] / np.sqrt(values[good]), np.ones((24, 1))])
    sides = np.array([[1.0, -1.0] if x == "a" else [-1.0, 1.0] for _, x in rows])
    want = phi @ np.linalg.solve(phi.T @ phi + 0.05 * np.eye(phi.shape[1]), phi.T @ sides)
    assert np.allclose(p @ matrix[:-1] + matrix[-1], want, atol=1e-3)


def test_language_of_odd_rows(spark):
    rows = [(1, "aa bb aa", "x"), (1, "aa bb aa", "x"), (2, "zz yy zz", "y"), (3, "zz yy", "y"), (None, "aa bb", "x"), (4, "aa bb " * 100_000, None), (5, None, "x"), (6, "42", None)]
    out = sorted(((r.doc_id, r.lang_pred) for r in langid.identify(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, score int")).collect()), key=str)
    assert len(out) == len(rows) and all(x in ("x", "y", "und") for _, x in out)
    assert [x for i, x in out if i in (5, 6)] == ["und", "und"] and [x for i, x in out if i == 4] == ["x"]
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def plain_ftrl(rows, size, epochs, alpha, beta, l1, l2, seed):
    """Coordinate by coordinate."""
    z, n = [0.0] * size, [0.0] * size

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - np.sign(z[k]) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, x, y = rows[k]
            w = [weight(i) for i in index]
            error = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - y
            for i, v, a in zip(index, x, w, strict=True):
                g = error * v
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * a
                n[i] += g * g
    return [weight(k) for k in range(size)]


def test_training_and_scores_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["good", "fine", "words"] if k % 2 else ["BUY!!", "now", "$$$"]) for _ in range(8)) for k in range(30)]
    rows = [(*quality.features(t, 8), k % 2) for k, t in enumerate(texts)]
    weights = quality.train(rows, 8, epochs=3)
    assert np.allclose(weights, plain_ftrl(rows, 256, 3, 1.0, 1.0, 0.02, 0.02, 9), atol=1e-6)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, None), (99, ""), (100, "word " * 200_000)], "doc_id long, text string")
    out = docs.select("text", quality.scorer(spark, weights, 8)("text").alias("score")).collect()
    for r in out:
        index, x = quality.features(r.text, 8)
        assert np.isclose(r.score, 1 / (1 + np.exp(-float(np.dot(weights[index], x)))), atol=1e-9)
    assert quality.classify(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


@pytest.mark.parametrize("size", [64, 65, 500])
def test_shapes_of_long_words_are_whole(size):
    assert quality.Shapes()["a" * size + "!"][1] != quality.Shapes()["a" * size][1]


def test_a_signature_of_many_sets_is_told_once():
    rng = np.random.default_rng(5)
    sig, node = rng.integers(0, 40, 400), rng.integers(0, 60, 400)
    made = jaccard._shared_once(sig, node)

    def components(sig, node):
        low = {}
        for _ in range(70):
            by_sig = {}
            for s, n in zip(sig, node, strict=True):
                by_sig[s] = min(by_sig.get(s, n), low.get(n, n))
            for s, n in zip(sig, node, strict=True):
                low[n] = min(low.get(n, n), by_sig[s])
        return low

    assert components(made["sig"].tolist(), made["node"].tolist()) == components(sig.tolist(), node.tolist())
    once = [s for s in made["sig"].tolist() if 0 <= s < 40]
    assert len(once) == len(set(once)) == len(set(sig.tolist()))


def test_scores_of_odd_rows_and_many_targets(spark):
    rows = [(None, "a b c"), (1, "a b"), (2, "b c " * 50_000), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    targets = spark.createDataFrame([(1,), (None,), (7,)], "doc_id long")
    few, many = ({(r.doc_id, r.n_words, r.is_target, round(r.score, 9)) for r in lmscore.scores(docs, targets, broadcast_ids=k).collect()} for k in (100, 0))
    assert few == many and {(i, n, t) for i, n, t, _ in few} == {(None, 3, False), (1, 2, True), (2, 100_000, False), (3, 0, False)}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Gone:
        def isDefined(self):
            return False

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": lambda self: Gone()})()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Fake())
