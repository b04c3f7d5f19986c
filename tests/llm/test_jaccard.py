import random

import numpy as np
import pytest

from voxloom.llm import jaccard, sigtree
from voxloom.llm.components import connected_components


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    low = list(range(len(rows)))

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[root(k)] = min(best.get(root(k), 1 << 60), i)
    return sorted((i, len(sets[k]), best[root(k)]) for k, (i, _) in enumerate(rows))


def made(seed, groups, copies, most):
    """Texts with copies about the threshold: each changes some words of one before it."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [rng.choice(["the", "Loom", "é", "run"]) if rng.random() < 0.3 else f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, most))]
        texts = [base]
        for _ in range(rng.randint(0, copies)):
            words = list(rng.choice(texts))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(words))
                words[k : k + rng.randint(0, 1)] = [f"x{rng.randrange(99)}"]
            texts.append(words or ["a"])
        rows += [" ".join(t) for t in texts]
    passage = " ".join(f"p{k}" for k in range(8))
    rows = [f"{t} {passage}" if rng.random() < 0.3 else t for t in rows] + [None, "", " \t", "one", "ONE", "one two", "one two"]
    rng.shuffle(rows)
    return [(7 * k + 3, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent", "block", "seed"), [(4, 85, 2048, 1), (5, 80, 2048, 2), (4, 85, 8, 3), (2, 60, 6, 4)])
def test_equals_brute_force(spark, n, percent, block, seed):
    rows = made(seed, 60, 8, 60)
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n long").repartition(5)
    out = jaccard.jaccard_components(docs, n=n, percent=percent, block=block).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, n, percent)


def test_one_large_group_in_blocks(spark):
    rows = made(9, 2, 150, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.jaccard_components(docs, n=4, percent=85, block=10, broadcast_rows=0).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, 4, 85)


def test_repeated_rows_null_ids_and_none(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(5, text), (5, text), (9, text), (None, "x y z"), (None, None), (4, "other words stand here now")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert out == sorted([(5, 5), (5, 5), (9, 5), (None, None), (None, None), (4, 4)], key=str)
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_signatures_miss_no_link():
    rng = np.random.default_rng(1)
    ranges = jaccard.size_ranges(85)
    for _ in range(4000):
        size = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        gone = int(rng.integers(0, size * 0.1 + 1))
        more = int(rng.integers(0, size * 0.1 + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
        if sigtree.links(x, y, 85) and (len(x) != len(y) or (x != y).any()):
            assert len(np.intersect1d(jaccard.signatures(x, 85, ranges), jaccard.signatures(y, 85, ranges)))


def test_trees_equal_pairs():
    rng = np.random.default_rng(2)
    for turn in range(6):
        base = [np.unique(rng.integers(0, 1 << 60, int(rng.integers(5, 200))).astype(np.uint64)) for _ in range(12)]
        sets = []
        for _ in range(300):
            b = base[int(rng.integers(12))]
            sets.append(np.unique(np.concatenate([b[rng.random(len(b)) > 0.06 * turn], rng.integers(0, 1 << 60, turn).astype(np.uint64)])))
        label, want = np.arange(300), np.arange(300)
        sigtree.join(sets, label, 85)
        for i in range(300):
            for j in range(i):
                if want[i] != want[j] and sigtree.links(sets[i], sets[j], 85):
                    want[want == max(want[i], want[j])] = min(want[i], want[j])
        assert (label == want).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(5, 5), (None, 3)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {}
    for _ in range(60):
        for a, b in edges:
            if a is not None and a != b:
                low[a] = low[b] = min(low.get(a, a), low.get(b, b))
    assert out == low


def test_very_long_texts(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    near = [*words[:60_000], "new", *words[60_000:]]
    docs = spark.createDataFrame([(4, " ".join(words)), (2, " ".join(near)), (9, " ".join(words[:60_000])), (1, "short")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs, n=4, percent=85).collect()} == {(4, 2), (2, 2), (9, 9), (1, 1)}
