import random
from collections import Counter

import numpy as np

from voxloom.llm import lmscore


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        topic = "abcdefgh" if i % 3 else "stuvwxyz"
        rows.append((i, " ".join(rng.choice(topic + "mn") + rng.choice("12") for _ in range(rng.randint(0, 30)))))
    rows += [(500, None), (501, "unseen WORDS only"), (501, "unseen WORDS only")]
    targets = [(i,) for i in range(0, 120, 3)] + [(0,), (None,)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_words int").repartition(3)
    out = lmscore.scores(docs, spark.createDataFrame(targets, "doc_id long")).collect()
    assert len(out) == len(rows)

    chosen = {t for (t,) in targets}
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        words = (t or "").lower().split()
        side = 0 if i in chosen else 1
        uni[side].update(words)
        bi[side].update(zip(["<unk>", *words], words, strict=False))
    known = set(uni[0]) | set(uni[1])
    total = [sum(u.values()) for u in uni]
    scale = (1, total[0] / total[1])

    def loss(words, side):
        made = []
        for h, w in zip(["<unk>", *words], words, strict=False):
            c = uni[side][h] * scale[side] if h != "<unk>" else 0
            weight = c / (c + lmscore.K)
            p = (1 - weight) * (uni[side][w] * scale[side] + 1) / (total[side] * scale[side] + len(known) + 1)
            if c:
                p += weight * bi[side][h, w] * scale[side] / c
            made.append(-np.log(p))
        return float(np.mean(made)) if made else 0.0

    texts = {}
    for i, t in rows:
        texts[i] = (t or "").lower().split()
    for r in out:
        words = texts[r.doc_id]
        assert r.n_words == len(words) and r.is_target == (r.doc_id in chosen)
        assert np.allclose([r.loss_target, r.loss_background], [loss(words, 0), loss(words, 1)], atol=1e-4)
    mean = lambda side: np.mean([r.score for r in out if r.is_target == side and r.n_words])
    assert mean(True) < -0.5 < 0.5 < mean(False)


def test_nothing(spark):
    docs = spark.createDataFrame([(1, "a a a b b c"), (2, "a b d e")], "doc_id long, text string")
    assert lmscore.scores(docs.limit(0), docs.limit(0).select("doc_id")).count() == 0
    assert all(np.isfinite(r.score) for r in lmscore.scores(docs, docs.limit(0).select("doc_id")).collect())


def test_mid_frequency_words_count_in_any_vocabulary(spark):
    """9,000 words of one count each: none of them is cut, in any number of chunks."""
    of = lambda side, i: " ".join(f"{side}{(i * 50 + j) % 4500}" for j in range(100))
    docs = spark.createDataFrame([(i, of("t" if i % 2 else "b", i // 2)) for i in range(360)], "doc_id long, text string").repartition(3)
    targets = docs.filter("doc_id % 2 = 1 AND doc_id < 300").select("doc_id")
    whole = {r.doc_id: r for r in lmscore.scores(docs, targets).collect()}
    apart = {r.doc_id: r for r in lmscore.scores(docs, targets, chunk=700, block=300).collect()}
    assert all(r.score < -0.1 for i, r in whole.items() if i % 2 and i < 300)
    assert all(r.score > 0.1 for i, r in whole.items() if not i % 2)
    assert set(whole) == set(apart) == set(range(360))
    assert all(np.isclose(whole[i].score, apart[i].score) and whole[i].n_words == apart[i].n_words for i in whole)
