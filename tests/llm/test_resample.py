import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from voxloom.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, n):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


def brute(docs, targets, n, buckets, percent, least):
    of = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in runs(t, n)[1])
    s, t = of(x for _, x in docs), of(targets)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        found = runs(text, n)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in found[1])
        rows.append([i, len(found[1]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), found[0]])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -(1 << 62) if r[0] is None else r[0]))
    ranks = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return Counter((*r[:4], ranks.get(id(r))) for r in rows)


def test_ring_gives_the_crc_of_every_run():
    rng = random.Random(1)
    for n in (1, 2, 3, 5):
        for length in (0, 1, 2, 4, 30):
            words = [rng.choice([b"a", b"word", "é".encode(), b"0"]) for _ in range(length)]
            want = [zlib.crc32(b" ".join(words[i:j])) for j in range(1, length + 1) for i in range(max(0, j - n), j)]
            assert resample.ring_states(words, n) == want


@pytest.mark.parametrize("n,buckets", [(1, 10_000), (2, 50), (3, 1)])
def test_against_a_plain_version(spark, n, buckets):
    rng = random.Random(n)
    vocabulary = ["The", "the", "naïve", "ÉTÉ", "x1", "日本", *(f"w{i}" for i in range(50))]
    text = lambda: rng.choice([" ", "-", ".\n"]).join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.choice([0, 1, 19, 20, 60])))
    docs = [(i * 7 - 50, rng.choice([None, ""]) if rng.random() < 0.05 else text()) for i in range(300)]
    copy = " ".join(vocabulary)
    docs += [(5000 + i, copy) for i in range(100)] + [(9999, copy)] * 40 + [(None, copy), (None, text()), docs[3]]
    targets = [text() for _ in range(20)] + [None]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS own", "3 AS rank", "4 AS range")
    kw = dict(n=n, buckets=buckets, percent=30, least_words=20)
    got = resample.resampled(df, spark.createDataFrame([(t,) for t in targets], "text string"), per_range=40, **kw).collect()
    assert Counter(tuple(r) for r in got) == brute(docs, targets, n, buckets, 30, 20)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, max(r["rank"] or 0 for r in got) + 1))


def test_draws_follow_the_target(spark):
    docs = spark.createDataFrame([(i, ("apple pear plum " if i % 2 else "iron zinc lead ") * 10) for i in range(400)], "doc_id long, text string")
    drawn = resample.resampled(docs, spark.createDataFrame([("apple pear plum",)] * 5, "text string")).filter("rank IS NOT NULL").collect()
    assert len(drawn) == 40 and all(r.doc_id % 2 for r in drawn)


def test_without_rows_or_targets(spark):
    none, docs = spark.createDataFrame([], "doc_id long, text string"), [(1, "a b " * 30), (2, None)]
    assert resample.resampled(none, none).count() == 0
    got = resample.resampled(spark.createDataFrame(docs, "doc_id long, text string"), none, percent=100).collect()
    assert Counter(tuple(r) for r in got) == brute(docs, [], 1, 10_000, 100, 20)


def test_very_long_text(spark):
    docs = [(1, "Word und naïve " * 200_000), (2, "word " * 20)]
    got = resample.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("word",)], "text string"), percent=50).collect()
    assert Counter(tuple(r) for r in got) == brute(docs, ["word"], 1, 10_000, 50, 20)
