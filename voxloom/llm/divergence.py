"""Operator 11: divergence audit of sources by joint count histograms.

Within each language the terms of at least `least_docs` documents are kept. A source,
or a language as a whole, gives each kept term a smoothed share in billionths,

    p = 1 + floor(10^9 (count + 2) / (N + 2 V)),

N its occurrences of kept terms, V their number. Two shares are held against each other
by f = floor((p - q)^2 / (p + q)). The audit has two parts: for each source every other
source of its language, by the sum of f over all kept terms (`pair`), and the terms that
mark a source against its language, by f (`term`).

The sum over a pair of sources is made from the joint histogram of their counts:
f is evaluated once for each different (count, count) that the pair has, times the
number of terms with it. Only terms that both sources have are ever joined. Cells with a
zero are implied: how many terms have the count c in one source and none in the other
is the one source's own histogram at c less the joint one, and the terms in neither are
what remains of V. So with j the joint histogram, h a source's own and 0 for count 0,

    sum f = sum_j j (f(a,b) - f(a,0) - f(0,b) + f(0,0)) + sum_h h (f(a,0) - f(0,0))
            + sum_h h (f(0,b) - f(0,0)) + V f(0,0).

All numbers are whole and exact (decimals of 38 digits where 64 bits may not do). Words
are counted in each task before any shuffle; all else is joins and aggregations of these
counts. What a pair or a language needs never meets in one task but as its sums.

Defined cases: null text, lang and source are ''; a group is there even if it has no
text or no kept term; a language without kept terms has pairs of value 0 and no terms;
repeated rows are documents each; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import written
from voxloom.session import on_workers

BILLION = 1_000_000_000
HELD = 400_000  # different (lang, source, term) that a task counts before it hands them on
#: What each byte of UTF-8 becomes: letters in lower case, all beyond ASCII as it is, else a space.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def term_counts(docs: DataFrame, *, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; a null term for each group of docs (text, lang, source)."""
    on_workers(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}

        def told() -> Iterator[pd.DataFrame]:
            for (lang, source), (n, in_docs) in groups.items():
                of = list(n)
                yield pd.DataFrame({"lang": lang, "source": source, "term": [*(t.decode("utf-8", "replace") for t in of), None], "n": [*n.values(), 0], "docs": [*(in_docs[t] for t in of), 0]})
            groups.clear()

        size = 0
        for batch in batches:
            for text, lang, source in zip(batch["text"], batch["lang"], batch["source"], strict=True):
                if (lang, source) not in groups:
                    groups[lang, source] = Counter(), Counter()
                    size += 1
                n, in_docs = groups[lang, source]
                found, before = terms(text), len(n)
                n.update(found)
                in_docs.update(set(found))
                size += len(n) - before
                if size >= held:
                    yield from told()
                    size = 0
        yield from told()

    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    dealt = filled.mapInPandas(count, _COUNTS).repartition("lang", "term")  # a task's rows are hardly ever alike; what goes on by term needs no other shuffle
    return dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count, total, terms):
    """p in billionths of a count, exact for any count of 64 bits."""
    big = "decimal(38,0)"
    top = F.lit(BILLION).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + 2)
    return (F.call_function("div", top.cast(big), (total + 2 * terms).cast(big)) + 1).cast("long")


def spread(p, q):
    """f of two shares; both are 1 to a billion and one, so 64 bits hold the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, *, least_docs: int = 10, top: int = 10, held: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank for all groups of docs (text, lang, source): all pairs of sources, and the top terms of each."""
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs, held=held).withColumns({"in_docs": F.sum("docs").over(of_term), "whole": F.sum("n").over(of_term), "first": F.min("source").over(of_term)})
    counts = counts.filter((F.col("in_docs") >= least_docs) | F.col("term").isNull()).select("lang", "source", "term", "n", "whole", (F.col("source") == F.col("first")).alias("one"))
    counts = written(counts, "kept-terms")
    found = counts.filter("term IS NOT NULL")

    langs = found.groupBy("lang").agg(F.sum("n").alias("of_lang"), F.sum(F.col("one").cast("long")).alias("v"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(found.groupBy("lang", "source").agg(F.sum("n").alias("of_source"), F.count("*").alias("own")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").na.fill(0, ["of_source", "own", "of_lang", "v"])
    p_of = lambda n, total: F.when(F.col("v") > 0, share(n, F.col(total), F.col("v"))).otherwise(0)
    groups = written(groups.withColumns({"p0": p_of(F.lit(0), "of_source"), "id": F.monotonically_increasing_id()}), "groups")

    shared = written(found.join(groups.select("lang", "source", "id", "of_source", "of_lang", "v", "p0"), ["lang", "source"]).select("lang", "source", "id", "term", "n", p_of(F.col("n"), "of_source").alias("p"), p_of(F.col("whole"), "of_lang").alias("q"), "p0"), "shares")

    # terms of a source, against its language
    f = shared.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), spread(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    marks = f.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    # pairs of sources: joint histograms of what both have, each pair once
    a = shared.select("lang", "term", F.col("id").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("p0").alias("za"))
    b = shared.select("lang", "term", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("p0").alias("zb"))
    joint = a.join(b, ["lang", "term"]).filter("a < b").groupBy("a", "b", "na", "nb", "pa", "pb", "za", "zb").agg(F.count("*").alias("m"))
    cell = lambda x, y: spread(F.col(x), F.col(y))
    both = joint.groupBy("a", "b").agg(F.sum(F.col("m") * (cell("pa", "pb") - cell("pa", "zb") - cell("za", "pb") + cell("za", "zb"))).alias("both"))

    # what a source has, against none of it in another: by its own histogram
    own = shared.groupBy("lang", "id", "n", "p").agg(F.count("*").alias("m"))
    zeros = groups.select("lang", F.col("id").alias("other"), F.col("p0").alias("z"))
    alone = own.join(zeros, "lang").filter("id <> other").groupBy("id", "other").agg(F.sum(F.col("m") * cell("p", "z")).alias("alone"), F.sum("m").alias("had"))
    x = groups.select("lang", "source", "v", F.col("id").alias("x"), F.col("p0").alias("zx"))
    y = groups.select("lang", F.col("source").alias("item"), F.col("id").alias("y"), F.col("p0").alias("zy"))
    pairs = x.join(y, "lang").filter("x <> y")
    pairs = pairs.join(both.select(F.col("a").alias("x"), F.col("b").alias("y"), "both").unionByName(both.select(F.col("b").alias("x"), F.col("a").alias("y"), "both")), ["x", "y"], "left")
    pairs = pairs.join(alone.select(F.col("id").alias("x"), F.col("other").alias("y"), F.col("alone").alias("alone_x"), F.col("had").alias("had_x")), ["x", "y"], "left")
    pairs = pairs.join(alone.select(F.col("id").alias("y"), F.col("other").alias("x"), F.col("alone").alias("alone_y"), F.col("had").alias("had_y")), ["x", "y"], "left").na.fill(0, ["both", "alone_x", "had_x", "alone_y", "had_y"])
    none = F.when(F.col("v") > 0, cell("zx", "zy")).otherwise(0)
    value = F.col("both") + F.col("alone_x") + F.col("alone_y") + (F.col("v") - F.col("had_x") - F.col("had_y")) * none
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(marks)
