"""Language-code functions (M1-M7) over columns and arrays of codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.text import _c, base_language

# Codes that mean another code's language.
ALIASES = {"nb": "no", "fil": "tl"}
SCRIPTS = ("zh-Hans", "zh-Hant")


def canonical(code) -> Column:
    """M2: the base code, aliases resolved."""
    base = base_language(code)
    out = base
    for alias, meant in ALIASES.items():
        out = F.when(base == alias, meant).otherwise(out)
    return out


def base_by_hyphen(code) -> Column:
    """M2 as the picker reads it: only - ends the base."""
    return F.regexp_extract(_c(code), "^[^-]*", 0)


def without_script(code) -> Column:
    return F.when(_c(code).isin(*SCRIPTS), "zh").otherwise(_c(code))


def canonical_list(codes) -> Column:
    """M3: Chinese scripts folded, each code once, first places kept."""
    return F.array_distinct(F.transform(_c(codes), without_script))


def _first(codes, test) -> Column:
    return F.try_element_at(F.filter(_c(codes), test), F.lit(1))


def effective_language(intent, supported, can_detect) -> Column:
    """M1: the code to hand to a model for a wanted language."""
    i, s = _c(intent), _c(supported)
    found = F.coalesce(_first(s, lambda x: base_language(x) == base_language(i)), _first(s, lambda x: canonical(x) == canonical(i)))
    wanted = F.when(i != "auto", F.when(found.isNotNull() & i.isin(*SCRIPTS), i).otherwise(found))
    fallback = F.coalesce(_first(s, lambda x: base_language(x) == "en"), without_script(F.try_element_at(s, F.lit(1))))
    return F.when(F.size(s) == 0, i).otherwise(F.coalesce(wanted, F.when(_c(can_detect), "auto"), fallback))


def evidence(selected, hint, supported, translated) -> Column:
    """M4: struct of the kind of evidence for the output's language, and the language."""
    h, s = _c(hint), _c(supported)
    made = lambda kind, lang=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if lang is None else lang).alias("lang"))
    chosen = (_c(selected) != "auto") & (canonical(selected) == canonical(h))
    return (
        F.when(_c(translated), made("translated", F.lit("en")))
        .when(h.isNotNull() & ~h.isin("", "auto"), F.when(chosen, made("user_selected", h)).otherwise(made("model_constrained", h)))
        .when(F.size(s) == 1, made("model_constrained", F.try_element_at(s, F.lit(1))))
        .otherwise(made("unknown"))
    )


def with_detected(found, detected) -> Column:
    """M5: unknown evidence becomes the language that a model detected; other evidence stays."""
    f, d = _c(found), _c(detected)
    usable = (f["kind"] == "unknown") & d.isNotNull() & ~d.isin("", "auto")
    return F.when(usable, F.struct(F.lit("model_detected").alias("kind"), d.alias("lang"))).otherwise(f)


def run_plan(translate, effective, model_languages, can_translate) -> Column:
    """M6: struct of task, language and target language of a run: a language only if the model lists it, translation only if it can and the source isn't English."""
    wanted = F.when(_c(effective) != "auto", without_script(effective))
    lang = F.when(F.array_contains(_c(model_languages), wanted), wanted)
    does = F.coalesce(_c(translate) & _c(can_translate) & ~F.coalesce(lang == "en", F.lit(False)), F.lit(False))
    return F.struct(F.when(does, "translate").otherwise("transcribe").alias("task"), lang.alias("language"), F.when(does, "en").alias("target"))


def supports(codes, wanted) -> Column:
    """M7: whether a list of codes holds a language, aliases and scripts aside."""
    return F.exists(_c(codes), lambda x: canonical(without_script(x)) == canonical(without_script(wanted)))


def capability_languages(codes) -> Column:
    """M7: the distinct languages of a list of codes."""
    return F.array_distinct(F.transform(_c(codes), lambda x: canonical(without_script(x))))


#: M2-like pairs of three- and two-letter codes that the detector gate maps; further ones can be passed.
THREE_TO_TWO = {"eng": "en", "deu": "de", "fra": "fr", "spa": "es", "por": "pt", "ita": "it", "nld": "nl", "rus": "ru", "ukr": "uk", "pol": "pl", "jpn": "ja", "kor": "ko", "cmn": "zh", "vie": "vi", "ara": "ar", "tur": "tr"}
MIN_CONFIDENCE = 0.9


def gated_codes(model_codes, known: dict[str, str]) -> Column:
    """A model's codes as two-letter codes, without those of languages that aren't known."""
    to_two = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    fold = lambda code: F.coalesce(F.try_element_at(to_two, F.lower(base_language(F.trim(code)))), F.lower(base_language(F.trim(code))))
    return F.filter(F.transform(_c(model_codes), fold), lambda x: x.isin(*known.values()))


def gated_detection(detected, reliable, confidence, model_codes, known: dict[str, str] | None = None) -> Column:
    """The language that a detector found (three letters) as a two-letter code, if it is reliable and the model can output it.

    Without model codes there is no constraint; if none of them is known to the
    detector, nothing can be told. The detector itself is the caller's.
    """
    pairs = known or THREE_TO_TWO
    to_two = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    two = F.try_element_at(to_two, _c(detected))
    allowed = gated_codes(model_codes, pairs)
    can = (F.size(_c(model_codes)) == 0) | F.array_contains(allowed, two)
    return F.when(_c(reliable) & (_c(confidence) >= MIN_CONFIDENCE) & can, two)


def script_conversion(effective) -> Column:
    """Which conversion of Chinese script the effective language asks for; null for none. The dictionaries are the caller's."""
    return F.when(_c(effective) == "zh-Hans", "to_simplified").when(_c(effective) == "zh-Hant", "to_traditional")
