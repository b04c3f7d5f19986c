import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import conversion


def plain(text, pairs):
    out, at = "", 0
    while at < len(text):
        hit = max((s for s in pairs if s and text.startswith(s, at)), key=len, default=None)
        out, at = out + (pairs[hit] if hit else text[at]), at + (len(hit) if hit else 1)
    return out


def test_longest_matches_equal_a_plain_search():
    rng = random.Random(1)
    for _ in range(300):
        word = lambda n: "".join(rng.choice("abc体體") for _ in range(n))
        pairs = {word(rng.randint(1, 5)): word(rng.randint(0, 3)) for _ in range(rng.randint(0, 12))}
        text = word(rng.randint(0, 40))
        assert conversion.Phrases(pairs).converted(text) == plain(text, pairs), (text, pairs)


def test_tables_and_rows(spark):
    table = spark.createDataFrame([("头发", "頭髮"), ("头", "頭"), ("发", "發"), ("发", "髮"), (None, "x"), ("", "y"), ("后", None)], "source string, target string")
    phrases = conversion.phrases_of(table)
    rows = spark.createDataFrame([(1, "头发出发", "zh-Hant"), (2, "头发", "zh-Hans"), (3, None, "zh-Hant"), (4, "", "zh-Hant"), (5, "头" * 100_000, "zh-Hant")], "id int, text string, lang string")
    out = {r.id: r.text for r in conversion.convert(rows, phrases, wanted=F.col("lang") == "zh-Hant").collect()}
    assert out == {1: "頭髮出發", 2: "头发", 3: None, 4: "", 5: "頭" * 100_000}
    assert {r.text for r in conversion.convert(rows, conversion.phrases_of(table.limit(0))).collect()} == {"头发出发", "头发", None, "", "头" * 100_000}
    with pytest.raises(ValueError, match="bytes of phrases"):
        conversion.phrases_of(table, most_bytes=3)
