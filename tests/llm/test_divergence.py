import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.llm import divergence

SCHEMA = "text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least_docs, top):
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in [tuple(x or "" for x in r) for r in rows]:
        found = TERM.findall("".join(c.lower() if c.isascii() else c for c in text))
        counts[lang, source].update(found)
        in_docs[lang].update(set(found))
    out = set()
    for lang in in_docs:
        kept = [t for t, n in in_docs[lang].items() if n >= least_docs]
        groups = {s: {t: c[t] for t in kept} for (of, s), c in counts.items() if of == lang}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in groups.items()}
        q = {t: 1 + 10**9 * (whole[t] + 2) // (sum(whole.values()) + 2 * len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            marks = [(-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())), 1)}
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(marks)[:top], 1)}
    return out


def found(df, **kw):
    rows = [tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_terms_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "été", "ÉTÉ", "naïve", "x", "Zürich", "日本", "a1b", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = []
    for _ in range(300):
        source = rng.choice(["hot", "hot", "hot", "a", "b", "é", None, ""])
        words = rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.choice([0, 1, 5, 40, 400]))
        rows.append((rng.choice([" ", "-", "  \n"]).join(words), rng.choice(["en", "fr", None]), source))
    rows += rows[:20] + [(None, "en", "silent"), ("", "lonely", "one"), ("", "lonely", "two")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS term", "2 AS n", "'x' AS id")
    assert found(df, least_docs=3, top=4, held=50) == brute(rows, 3, 4)


def test_equal_values_are_ranked_by_bytes(spark):
    rows = [("b a é", "l", s) for s in ("z", "é", "y")] * 2
    got = found(spark.createDataFrame(rows, SCHEMA), least_docs=1)
    assert got == brute(rows, 1, 10)
    assert [i for _, i in sorted((r[5], r[3]) for r in got if r[1] == "y")] == ["z", "é"]


def test_languages_without_kept_terms(spark):
    got = found(spark.createDataFrame([("rare words", "l", "a"), ("others", "l", "b")], SCHEMA))
    assert got == {("l", "a", "pair", "b", 0, 1), ("l", "b", "pair", "a", 0, 1)}


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, v = 9_000_000_000_000, 9_000_000_000_007, 3
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_very_long_text(spark):
    rows = [("Word other " * 200_000, "l", "a"), ("word", "l", "b")]
    assert found(spark.createDataFrame(rows, SCHEMA), least_docs=1) == brute(rows, 1, 10)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_counts_are_dealt_once(spark):
    rows = spark.createDataFrame([("a b a", "en", "x"), ("b", "en", "y")], SCHEMA)
    counts = divergence.term_counts(rows)
    assert sorted((r.source, r.term, r.n, r.docs) for r in counts.filter("term IS NOT NULL").collect()) == [("x", "a", 2, 1), ("x", "b", 1, 1), ("y", "b", 1, 1)]
    whole = counts.withColumn("whole", F.sum("n").over(Window.partitionBy("lang", "term")))
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
