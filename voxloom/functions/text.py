"""Transcript cleaning as column functions.

White space and letters are Unicode's, so all patterns use the (?U) flag. The
functions are pure expressions and stay in code generation where Spark allows;
correct_terms alone consumes words greedily and is an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Filler words that every language drops, and those that need evidence of the language.
UNIVERSAL_FILLERS = ("uh", "uhm", "umm", "uhh", "uhhh", "ehh", "ehm", "ahm", "hmm", "hm", "mmm", "хм", "ммм")
GATED_FILLERS = {"en": ("um", "ah", "eh", "ha"), "de": ("äh", "ähm"), "fr": ("euh",)}

ALNUM = r"\p{IsAlphabetic}\p{Nd}\p{Nl}\p{No}"
SPACE = r"(?U)\s"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """The white-space tokens of a text, without empty ones."""
    return F.filter(F.split(_c(text), r"(?U)\s+"), lambda w: w != "")


def trimmed(text) -> Column:
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def match_key(word) -> Column:
    """Letters and digits, in lower case."""
    return F.lower(F.regexp_replace(_c(word), f"[^{ALNUM}]", ""))


def ngram_key(parts) -> Column:
    """The keys of an array of words, joined."""
    return F.array_join(F.transform(_c(parts), match_key), "")


def fuzzy_key_ok(key) -> Column:
    """T4: ASCII letters and digits, not empty."""
    return _c(key).rlike("^[A-Za-z0-9]+$")


def soundex_ok(key) -> Column:
    return _c(key).rlike("^[A-Za-z]+$")


def term_keys(term) -> Column:
    """A dictionary term's comparison keys, the second with & spelled out."""
    first, second = match_key(term), match_key(F.replace(_c(term), F.lit("&"), F.lit(" and ")))
    return F.filter(F.when(_c(term).contains("&") & (first != second), F.array(first, second)).otherwise(F.array(first)), fuzzy_key_ok)


def match_score(candidate, key) -> Column:
    """T5: distance of a candidate key from a term's key as a share of the longer one, less where both sound alike; null if the lengths are too far apart."""
    a, b = _c(candidate), _c(key)
    longer = F.greatest(F.length(a), F.length(b))
    share = F.levenshtein(a, b) / longer
    alike = soundex_ok(a) & soundex_ok(b) & (F.soundex(a) == F.soundex(b))
    fits = fuzzy_key_ok(a) & (F.length(a) <= 50) & (F.abs(F.length(a) - F.length(b)) <= F.greatest(longer * 0.25, F.lit(2.0)))
    return F.when(fits, F.when(alike, share * 0.3).otherwise(share))


def keep_case(original, replacement) -> Column:
    """The replacement in capitals, capitalised, or as it is, like the original word."""
    o, r = _c(original), _c(replacement)
    return (
        F.when(o.rlike(r"^\p{IsUppercase}*$"), F.upper(r))
        .when(o.rlike(r"^\p{IsUppercase}"), F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r))))
        .otherwise(r)
    )


def edge_punctuation(word) -> Column:
    """Struct of what stands before the first and behind the last letter or digit."""
    return F.struct(F.regexp_extract(_c(word), f"^[^{ALNUM}]*", 0).alias("prefix"), F.regexp_extract(_c(word), f"[^{ALNUM}]*$", 0).alias("suffix"))


def base_language(code) -> Column:
    """The part of a language code before the first - or _."""
    return F.regexp_extract(_c(code), "^[^-_]*", 0)


def drop_fillers(text, language=None, custom: Sequence[str] | None = None, enabled: bool = True) -> Column:
    """A text without filler words: the custom ones if given, else the universal ones and those of the (evident) language. Each goes with one comma or full stop after it."""
    out = _c(text)
    if not enabled or custom is not None and not custom:
        return out

    def without(column: Column, fillers: Sequence[str]) -> Column:
        for w in fillers:
            column = F.regexp_replace(column, rf"(?iU)\b\Q{w}\E\b[,.]?", "")
        return column

    if custom is not None:
        return without(out, list(custom))
    out = without(out, UNIVERSAL_FILLERS)
    if language is None:
        return out
    base, gated = base_language(language), None
    for lang, fillers in GATED_FILLERS.items():
        gated = (gated if gated is not None else F).when(base == lang, without(out, fillers))
    return gated.otherwise(out)


def collapse_stutters(text) -> Column:
    """Three or more equal words in a row (letters only, any case) become the first of them; a text of white space alone stays."""
    w = words(text)

    def kept(all_words: Column, low: Column) -> Column:
        """A word goes if it repeats the one before it and, with a further neighbour, makes three."""

        def stays(x: Column, i: Column) -> Column:
            near = lambda k: F.coalesce(F.get(low, i) == F.get(low, i + k), F.lit(False))
            return ~(near(-1) & (near(-2) | near(1)) & F.get(low, i).rlike(r"^\p{IsAlphabetic}+$"))

        return F.array_join(F.filter(all_words, stays), " ")

    return F.when(F.size(w) == 0, _c(text)).otherwise(_let(w, lambda a: _let(F.transform(a, F.lower), lambda low: kept(a, low))))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, though body uses it within other lambdas."""
    return F.transform(F.array(value), body)[0]


def normalize(text) -> Column:
    """Stutters collapsed, runs of white space made one space, edges trimmed."""
    return trimmed(F.regexp_replace(collapse_stutters(text), r"(?U)\s{2,}", " "))


def clean_transcript(
    text, language=None, *, detected=None, terms: Sequence[str] = (), threshold: float = 0.18, prompted: bool = False, fillers: Sequence[str] | None = None, enabled: bool = True
) -> Column:
    """Dictionary correction (unless the model was prompted with the terms), filler removal, normalisation.

    language: what is evident of the output's language; where it is null, `detected`
    (that which a detector finds in the text, as gated by lang.gated_detection) counts.
    A cleaning that fails gives the raw text: the correction keeps a text that it can't
    read, the rest are total functions of a text.
    """
    out = correct_terms(text, terms, threshold) if terms and not prompted else _c(text)
    known = _c(language) if language is not None else None
    if detected is not None:
        known = _c(detected) if known is None else F.coalesce(known, _c(detected))
    return F.coalesce(normalize(drop_fillers(out, known, fillers, enabled)), _c(text))


def entry_title(seconds) -> Column:
    """A title from Unix seconds, day and hour padded with a space; what is no time gets a plain title."""
    at = F.try_to_timestamp(F.date_format(F.timestamp_seconds(_c(seconds)), "yyyy-MM-dd HH:mm:ss"))
    made = F.concat(
        F.date_format(at, "MMMM "), F.lpad(F.dayofmonth(at).cast("string"), 2, " "), F.date_format(at, ", yyyy - "), F.lpad(((F.hour(at) + 11) % 12 + 1).cast("string"), 2, " "), F.date_format(at, ":mma")
    )
    return F.coalesce(made, F.concat(F.lit("Recording "), _c(seconds).cast("string")))


def strip_invisible(text) -> Column:
    """Without zero-width spaces, joiners and byte-order marks."""
    return F.translate(_c(text), "​‌‍﻿", "")


def strip_think_block(text) -> Column:
    """Without a leading <think> block and the white space around it; unclosed ones stay."""
    return F.regexp_replace(_c(text), r"(?sU)^\s*<think>.*?</think>\s*", "")


def system_prompt(prompt) -> Column:
    """The prompt without its output placeholder, trimmed."""
    return trimmed(F.replace(_c(prompt), F.lit("${output}"), F.lit("")))


def is_blank(text) -> Column:
    """T18."""
    return trimmed(text) == ""


def structured_transcript(content) -> Column:
    """The string field `transcription` of a JSON answer; without it, the answer itself, think block stripped."""
    raw = strip_think_block(content)
    parsed = F.try_parse_json(raw)
    is_text = F.schema_of_variant(F.try_variant_get(parsed, "$.transcription", "variant")) == "STRING"
    return F.coalesce(F.when(is_text, F.try_variant_get(parsed, "$.transcription", "string")), raw)


def chosen_post_text(answer, converted, original) -> Column:
    """The language model's answer if there is one, else the converted text where it differs from the original."""
    return F.coalesce(_c(answer), F.when(_c(converted) != _c(original), _c(converted)))


def trailing_space(text) -> Column:
    """T22."""
    return F.concat(_c(text), F.lit(" "))


def redacted_url(url) -> Column:
    """A URL without credentials, query and fragment."""
    return F.regexp_replace(F.regexp_replace(_c(url), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1"), r"[?#].*$", "")


def display_name(model_id) -> Column:
    """- and _ as spaces, each word's first letter a capital, the rest as it is."""
    parts = F.filter(F.split(F.translate(_c(model_id), "-_", "  "), " +"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def model_size(mb) -> Column:
    """Megabytes as text; gigabytes from 1024 on, one decimal below 10."""
    m = _c(mb).cast("double")
    gb = m / 1024
    number = lambda x, form: F.call_function("format_number", x, F.lit(form))
    return (
        F.when(m.isNull() | (m <= 0), "Unknown size")
        .when((m >= 1024) & (gb >= 10), F.concat(number(gb, "#,##0"), F.lit(" GB")))
        .when(m >= 1024, F.concat(number(gb, "0.0"), F.lit(" GB")))
        .when(m >= 100, F.concat(number(m, "0"), F.lit(" MB")))
        .otherwise(F.concat(number(m, "0.0"), F.lit(" MB")))
    )


def relative_time(seconds_ago) -> Column:
    """Struct of a count and its unit for an age in seconds."""
    s = _c(seconds_ago)

    def unit(size: int, name: str) -> Column:
        return F.struct(F.floor(s / size).cast("long").alias("n"), F.lit(name).alias("unit"))

    day = 86400
    return (
        F.when(s < 60, unit(1, "second")).when(s < 3600, unit(60, "minute")).when(s < day, unit(3600, "hour")).when(s < 7 * day, unit(day, "day"))
        .when(s < 30 * day, unit(7 * day, "week")).when(s < 365 * day, unit(30 * day, "month")).otherwise(unit(365 * day, "year"))
    )


def version(text) -> Column:
    """Struct of major, minor and patch; null if the text doesn't start with a version."""
    pattern = r"(?U)^\s*[vV]?(\d+)\.(\d+)\.(\d+)"
    return F.when(_c(text).rlike(pattern), F.struct(*[F.regexp_extract(_c(text), pattern, k + 1).cast("long").alias(n) for k, n in enumerate(("major", "minor", "patch"))]))


def resolve_ui_language(requested, known: Sequence[str]) -> Column:
    """The known language for a requested code: itself, the script of Chinese, or its base; null if none."""
    code = F.replace(_c(requested), F.lit("_"), F.lit("-"))
    low = F.lower(code)
    find = lambda wanted: F.try_element_at(F.filter(F.array(*map(F.lit, known)), lambda k: F.lower(k) == wanted), F.lit(1))
    tag = lambda *names: low.rlike(rf"(^|-)({'|'.join(names)})(-|$)")
    base = base_language(low)
    chinese = F.when(base == "yue", F.when(tag("hans"), "zh").otherwise("zh-tw")).when((base == "zh") & (tag("hant") | ~tag("hans") & tag("tw", "hk", "mo")), "zh-tw")
    return F.coalesce(find(low), find(F.coalesce(chinese, base)))


def correct_terms(text, terms: Sequence[str], threshold: float = 0.18) -> Column:
    """Words, or two or three together, that are close to a dictionary term become the term, from left to right. A text that can't be corrected stays as it is."""
    if not terms:
        return _c(text)
    from voxloom.functions.terms import Dictionary

    return correct_by(text, Dictionary(list(terms), threshold))


def correct_by(text, wanted) -> Column:
    """T6 by a Dictionary."""

    def corrected(value: str) -> str:
        try:
            return wanted.corrected(value)
        except Exception:
            return value

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(corrected, na_action="ignore")

    return run(_c(text))
