"""Golden cases of transcript cleaning and language codes, and random ones against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from voxloom.functions import lang, text

# Cases of known results.
FILLERS = [
    ("So uhm I was thinking uh about this", "en", None, "So I was thinking about this"),
    ("UHM this is UH a test", "en", None, "this is a test"),
    ("Well, uhm, I think, uh. that's right", "en", None, "Well, I think, that's right"),
    ("Hello    world   test", "en", None, "Hello world test"),
    ("  Uhm, so I was, uh, thinking about this  ", "en", None, "so I was, thinking about this"),
    ("w wh wh wh wh wh wh wh wh wh why", "en", None, "w wh why"),
    ("I I I I think so so so so", "en", None, "I think so"),
    ("No NO no NO no", "en", None, "No"),
    ("no no is fine", "en", None, "no no is fine"),
    ("um I think um this is good", "en", None, "I think this is good"),
    ("um gato bonito", "pt-BR", None, "um gato bonito"),
    ("ha sido un buen día", "es", None, "ha sido un buen día"),
    ("okay so I think right this works", "en", ["okay", "right"], "so I think this works"),
    ("So uhm I was thinking uh about this", "en", [], "So uhm I was thinking uh about this"),
    ("uhh bueno hmm creo que um ha llegado", None, None, "bueno creo que um ha llegado"),
    ("хм я думаю ммм это работает", None, None, "я думаю это работает"),
    ("ХМ я", None, None, "я"),
    ("äh ich glaube ähm das passt", None, None, "äh ich glaube ähm das passt"),
    ("äh ich glaube ähm das passt", "de", None, "ich glaube das passt"),
    ("the screw is 5 mm long", "en", None, "the screw is 5 mm long"),
    ("euh je pense que ça marche", "fr", None, "je pense que ça marche"),
    ("uhm", "en", None, ""),
    ("éuh", "en", None, "éuh"),
    (None, "en", None, None),
]
TERMS = [
    ("hello world", ["Hello", "World"], 0.5, "Hello World"),
    ("helo wrold", ["hello", "world"], 0.5, "hello world"),
    ("il cui nome è Charge B, che permette", ["ChargeBee"], 0.5, "il cui nome è ChargeBee, che permette"),
    ("use Chat G P T for this", ["ChatGPT"], 0.5, None),
    ("Open AI GPT model", ["OpenAI", "GPT"], 0.5, "OpenAI GPT model"),
    ("using Mac Book Pro", ["MacBook Pro"], 0.5, "using MacBook Pro"),
    ("send it to RD for review", ["R&D"], 0.18, "send it to R&D for review"),
    ("send it to R and D for review", ["R&D"], 0.18, "send it to R&D for review"),
    ("send it to R&D for review", ["R&D"], 0.18, "send it to R&D for review"),
    ("「Loomee。」", ["Loomy"], 0.5, "「Loomy。」"),
    ("你好。", ["你号"], 1.0, "你好。"),
    ("keep  the   gaps", [], 0.5, "keep  the   gaps"),
]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize(("source", "language", "custom", "want"), FILLERS)
def test_cleaning(spark, source, language, custom, want):
    df = spark.createDataFrame([(source, language)], "x string, lang string")
    assert df.select(text.clean_transcript("x", F.col("lang") if language else None, fillers=custom).alias("y")).first().y == want


@pytest.mark.parametrize(("source", "terms", "threshold", "want"), TERMS)
def test_terms(spark, source, terms, threshold, want):
    got = one(spark, source, text.correct_terms("x", terms, threshold))
    assert got == want if want else terms[0] in got


def test_capital_terms(spark):
    assert "CHARGEBEE" in one(spark, "CHARGE B is great", text.correct_terms("x", ["ChargeBee"], 0.5))
    assert "GPT-44" not in one(spark, "use GPT4 for this", text.correct_terms("x", ["GPT-4"], 0.5))


@pytest.mark.parametrize(("original", "replacement", "want"), [("HELLO", "world", "WORLD"), ("Hello", "world", "World"), ("hello", "WORLD", "WORLD"), ("I", "yes", "YES"), ("HELLO,", "world", "World")])
def test_case(spark, original, replacement, want):
    assert one(spark, original, text.keep_case("x", F.lit(replacement))) == want


@pytest.mark.parametrize(("word", "prefix", "suffix"), [("!hello?", "!", "?"), ("「你好」", "「", "」"), ("...", "...", "..."), ("a", "", "")])
def test_edges(spark, word, prefix, suffix):
    from voxloom.functions import terms

    assert tuple(one(spark, word, text.edge_punctuation("x"))) == (prefix, suffix) == terms.edges(word)


def test_stutters_against_a_plain_model(spark):
    def plain(s):
        tokens, out, k = s.split(), [], 0
        if not tokens:
            return s
        while k < len(tokens):
            n = 1
            while k + n < len(tokens) and tokens[k + n].lower() == tokens[k].lower():
                n += 1
            keep = 1 if n >= 3 and tokens[k].isalpha() else n
            out += tokens[k : k + keep]
            k += n
        return " ".join(out)

    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "A", "é", "b1", "B1", "no", "No,", "ß"]) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["", "  \n ", " x  x x "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string").select("k", text.collapse_stutters("x").alias("y"))
    assert {r.k: r.y for r in df.collect()} == {k: plain(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize(("source", "want"), [(" <think>a\nb</think>  x", "x"), ("  <think>open", "  <think>open"), ("x <think>a</think>", "x <think>a</think>"), ("<think>a</think>b</think>c", "b</think>c")])
def test_think(spark, source, want):
    assert one(spark, source, text.strip_think_block("x")) == want


@pytest.mark.parametrize(
    ("intent", "supported", "detect", "want"),
    [("de", [], False, "de"), ("en", ["en-US", "de"], False, "en-US"), ("nb", ["no", "nb"], False, "nb"), ("nb", ["no"], False, "no"), ("zh-Hans", ["zh"], False, "zh-Hans"), ("auto", ["de", "en"], True, "auto"), ("auto", ["de", "en-GB"], False, "en-GB"), ("fr", ["zh-Hant"], False, "zh"), ("fil", ["tl"], False, "tl")],
)
def test_effective_language(spark, intent, supported, detect, want):
    df = spark.createDataFrame([(intent, supported, detect)], "i string, s array<string>, d boolean")
    assert df.select(lang.effective_language("i", "s", "d").alias("y")).first().y == want


def test_titles(spark):
    assert one(spark, "", text.entry_title(F.lit(1_704_441_600))) == "January  5, 2024 -  8:00AM"
    assert one(spark, "", text.display_name(F.lit("my-model_bC"))) == "My Model BC"
