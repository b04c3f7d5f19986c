"""Catalog building and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.lang import canonical, without_script
from voxloom.operators.registry import KNOWN_ARCHES

# Scales of the scores, order of quantisations with a word error rate, families in order of their search.
SPEED_SCALE, ACCURACY_SCALE, SPEED_FLOOR = 8.0, 15.0, 10
WER_QUANTS = ("q8_0", "f16", "q5_k_m", "q6_k", "q4_k_m", "f32", "bf16")
FAMILIES = ("whisper", "moonshine-streaming", "moonshine", "parakeet", "canary-qwen", "canary", "voxtral", "granite-speech", "granite", "qwen3", "gigaam", "sensevoice", "cohere", "fun-asr", "nemotron", "medasr", "moss", "sortformer")
TAGS = ("whisper", "moonshine", "parakeet", "canary", "voxtral", "granite", "qwen3", "gigaam", "sensevoice", "cohere")
ACRONYMS = {"asr": "ASR", "ctc": "CTC", "rnnt": "RNNT", "tdt": "TDT", "nar": "NAR", "mlt": "MLT"}
LANGUAGE_NAMES = {"en": "English", "ar": "Arabic", "ja": "Japanese", "ko": "Korean", "ru": "Russian", "uk": "Ukrainian", "vi": "Vietnamese", "zh": "Chinese"}
LARGE_BILLIONS = 1.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def speed_score(rtf) -> Column:
    """rounded half to even; the floor without a factor."""
    r = _c(rtf)
    return F.when(r.isNull() | (r <= 0), SPEED_FLOOR).otherwise(F.bround(100 * (1 - F.exp(-r / SPEED_SCALE))).cast("int"))


def accuracy_score(wer) -> Column:
    """F2."""
    return F.bround(100 * F.exp(-_c(wer) / ACCURACY_SCALE)).cast("int")


def benchmark_rtf(by_backend) -> Column:
    """the factor of vulkan where that key is, even if null, else of cpu."""
    m = _c(by_backend)
    return F.when(F.map_contains_key(m, "vulkan"), m["vulkan"]).otherwise(F.try_element_at(m, F.lit("cpu")))


def headline_wer(by_set) -> Column:
    """the word error rate of the first known quantisation in the first set of librispeech, English fleurs, any fleurs. by_set: map of set to map of quantisation to rate."""
    m = _c(by_set)
    fleurs = F.try_element_at(F.filter(F.map_keys(m), lambda k: k.startswith("wer_fleurs")), F.lit(1))
    chosen = F.when(F.map_contains_key(m, "wer_librispeech_test_clean"), F.try_element_at(m, F.lit("wer_librispeech_test_clean"))).when(F.map_contains_key(m, "wer_fleurs_en"), F.try_element_at(m, F.lit("wer_fleurs_en"))).otherwise(F.try_element_at(m, fleurs))
    quant = F.try_element_at(F.filter(F.array(*map(F.lit, WER_QUANTS)), lambda q: F.map_contains_key(chosen, q)), F.lit(1))
    return F.try_element_at(chosen, quant)


def quant_of(filename) -> Column:
    """the quantisation in a file's name, ? without."""
    # Fixed value: the grammar of such file names.
    found = F.regexp_extract(_c(filename), r"-(F32|F16|BF16|Q\d[\w_]*?)\.gguf$", 1)
    return F.when(found == "", "?").otherwise(found)


def billions(size_label) -> Column:
    """parameters in billions of a label such as 0.6B or 62M."""
    pattern = r"(?i)^\s*([\d.]+)\s*([BM])"
    value = F.regexp_extract(_c(size_label), pattern, 1).try_cast("double")
    return F.when(F.upper(F.regexp_extract(_c(size_label), pattern, 2)) == "M", value / 1000).otherwise(value)


def default_quant(files, size_label, curated=None) -> Column:
    """the curated quantisation, else by size, else Q8_0, any Q8, Q5_K_M, the first."""
    f = _c(files)
    has = lambda q: F.when(F.exists(f, lambda x: x["quant"] == q), q)
    policy = F.when(billions(size_label) >= LARGE_BILLIONS, has("Q5_K_M")).otherwise(has("Q8_0"))
    any_q8 = F.try_element_at(F.filter(f, lambda x: x["quant"].contains("Q8")), F.lit(1))["quant"]
    return F.coalesce(_c(curated) if curated is not None else F.lit(None), policy, has("Q8_0"), any_q8, has("Q5_K_M"), F.try_element_at(f, F.lit(1))["quant"])


def family(slug, tags) -> Column:
    """the first family in a name, else the first such tag, else other."""
    low, out = F.lower(_c(slug)), None
    for f in FAMILIES:
        out = (F if out is None else out).when(low.contains(f), f.split("-")[0])
    tag = F.try_element_at(F.filter(_c(tags), lambda t: t.isin(*TAGS)), F.lit(1))
    return out.otherwise(F.coalesce(tag, F.lit("other")))


def model_files(listing: DataFrame) -> DataFrame:
    """each repo's .gguf files (repo, filename, size_bytes, sha256) by size; one without a size or digest fails the run."""
    files = listing.filter(F.col("filename").endswith(".gguf"))
    bad = F.col("size_bytes").isNull() | (F.col("size_bytes") <= 0) | F.col("sha256").isNull() | (F.col("sha256") == "")
    size = F.when(bad, F.raise_error(F.concat(F.col("repo"), F.lit(": missing size or digest for "), F.col("filename"))).cast("long")).otherwise(F.col("size_bytes"))
    entry = F.struct(size.alias("size_bytes"), "filename", quant_of("filename").alias("quant"), "sha256")
    return files.groupBy("repo").agg(F.sort_array(F.collect_list(entry)).alias("files"))  # a repo's files are few


def auto_description(languages, caps) -> Column:
    """F8: a sentence on a model's languages and capabilities."""
    n, c = F.size(_c(languages)), _c(caps)
    feats = F.filter(
        F.array(
            F.when(c["translate"], "translation"), F.when(c["lang_detect"], "auto language detection"), F.when(c["streaming"], "streaming"),
            F.when(c["timestamps"] != "none", F.concat(c["timestamps"], F.lit("-level timestamps"))),
        ),
        lambda x: x.isNotNull(),
    )
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    one = F.try_element_at(_c(languages), F.lit(1))
    base = F.when(n > 1, F.concat(n.cast("string"), F.lit("-language speech-to-text"))).otherwise(F.concat(F.coalesce(F.try_element_at(names, one), one, F.lit("English")), F.lit(" speech-to-text")))
    return F.when(F.size(feats) > 0, F.concat(base, F.lit(" with "), F.array_join(feats, ", "), F.lit("."))).otherwise(F.concat(base, F.lit(".")))


def pretty_name(slug) -> Column:
    """F8: a slug's parts as words: acronyms, parts in capitals or with digits as they are, others capitalised."""
    acronyms = F.create_map(*[F.lit(x) for kv in ACRONYMS.items() for x in kv])

    def one(p: Column) -> Column:
        return F.coalesce(F.try_element_at(acronyms, F.lower(p)), F.when((p == F.upper(p)) & p.rlike("[A-Z]") | p.rlike(r"\d"), p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p))))))

    return F.array_join(F.transform(F.split(_c(slug), "-"), one), " ")


def visible(models: DataFrame, hidden: Sequence[str] = ()) -> DataFrame:
    """without hidden slugs."""
    return models.filter(~F.col("slug").isin(list(hidden))) if hidden else models


def catalog_order() -> list[Column]:
    """recommended, rank (0 and null last), family, speed, slug."""
    rank = F.when(F.coalesce("recommended_rank", F.lit(0)) == 0, 1e9).otherwise(F.col("recommended_rank"))
    return [F.desc("recommended"), rank.asc(), F.asc("family"), F.desc(F.coalesce("speed_score", F.lit(0))), F.asc("slug")]


def mirror_plan(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """what to do for each wanted object (key, repo, filename, sha256, size_bytes) against the mirror's objects (key, sha256): skip, mismatch, copy (the same bytes lie elsewhere under the repo) or upload."""
    there = objects.select("key", F.col("sha256").alias("_sha"), F.lit(True).alias("_there"))
    spare = objects.select(F.regexp_extract("key", r"^((?:[^/]+/)?[^/]+)/[^/]+/[^/]+$", 1).alias("repo"), F.regexp_extract("key", r"[^/]+$", 0).alias("filename"), "sha256").distinct().withColumn("_spare", F.lit(True))
    j = wanted.join(there.hint("merge"), "key", "left").join(spare.hint("merge"), ["repo", "filename", "sha256"], "left")  # keys made of few bytes look small enough to broadcast, and are not
    action = F.when(F.col("_there") & F.col("_sha").eqNullSafe(F.col("sha256")), "skip").when(F.col("_there"), "mismatch").when(F.col("_spare"), "copy").otherwise("upload")
    return j.select("key", "size_bytes", action.alias("action"))


def mirror_tally(plan: DataFrame) -> DataFrame:
    """objects of each action, and the bytes to upload."""
    return plan.groupBy("action").agg(F.count("*").alias("files"), F.sum(F.when(F.col("action") == "upload", F.col("size_bytes")).otherwise(0)).alias("upload_bytes"))


def verified(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """one row of missing, bad and ok counts of wanted (key, sha256) against stored (key, content)."""
    j = wanted.join(stored.select("key", F.sha2("content", 256).alias("_got")), "key", "left")
    count = lambda test: F.count(F.when(test, 1))
    return j.agg(count(F.col("_got").isNull()).alias("missing"), count(F.col("_got") != F.col("sha256")).alias("bad"), count(F.col("_got") == F.col("sha256")).alias("ok"))


def flattened(docs: DataFrame) -> DataFrame:
    """(lang, key_path) of all leaves of JSON documents (lang, content), level by level as deep as they go. Lists and empty objects are leaves."""
    level = docs.select("lang", F.lit("").alias("path"), F.parse_json("content").alias("v"))
    out = None
    while True:
        kids = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer())).select("lang", F.concat_ws(".", F.nullif("path", F.lit("")), "key").alias("path"), "value")
        nested = F.schema_of_variant("value").startswith("OBJECT") & (F.schema_of_variant("value") != "OBJECT<>")
        leaves = kids.filter(~nested).select("lang", F.col("path").alias("key_path"))
        out = leaves if out is None else out.unionByName(leaves)
        level = kids.filter(nested).select("lang", "path", F.col("value").alias("v"))
        if level.isEmpty():
            return out


def translation_audit(keys: DataFrame, reference: str = "en") -> DataFrame:
    """(lang, key_path, problem) of keys that a language lacks or has beyond the reference language."""
    ref, rest = keys.filter(F.col("lang") == reference).select("key_path"), keys.filter(F.col("lang") != reference)
    langs = rest.agg(F.collect_set("lang")).scalar()  # the languages, in one array
    having = rest.groupBy("key_path").agg(F.collect_set("lang").alias("_has"))
    lacking = F.array_except(langs, F.coalesce("_has", F.array().cast("array<string>")))
    missing = ref.join(having, "key_path", "left").select(F.explode(lacking).alias("lang"), "key_path", F.lit("missing").alias("problem"))
    return missing.unionByName(rest.join(ref, "key_path", "left_anti").select("lang", "key_path").withColumn("problem", F.lit("extra")))


def language_coverage(models: DataFrame, intents: DataFrame) -> DataFrame:
    """model languages that don't match exactly one intent (code), with the number of matches."""
    langs = models.select(F.explode("languages").alias("language")).distinct().withColumn("_k", canonical(without_script("language")))
    known = intents.select(canonical(without_script("code")).alias("_k"), "code").distinct()
    return langs.join(known, "_k", "left").groupBy("language").agg(F.count("code").alias("matches")).filter("matches <> 1")


def invariant_breaches(catalog: DataFrame, mirrors: int = 1) -> DataFrame:
    """(id, breach) of catalog rows against the rules: unique ids, scores from 0 to 100, hex digests, known architectures."""
    rows = catalog.filter("id IS NOT NULL")
    bad_sha = F.exists("files", lambda f: ~F.coalesce(f["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False)))
    tests = [
        (~F.coalesce(F.col("speed_score").between(0, 100), F.lit(True)) | ~F.coalesce(F.col("accuracy_score").between(0, 100), F.lit(True)), "score out of range"),
        (bad_sha, "bad digest"), (~F.coalesce(F.col("architecture"), F.lit("")).isin(*KNOWN_ARCHES), "unknown architecture"), (F.lit(mirrors < 1), "no mirror"),
    ]
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate id").alias("breach"))
    return rows.select("id", F.explode(F.array(*[F.when(t, name) for t, name in tests])).alias("breach")).filter("breach IS NOT NULL").distinct().unionByName(twice)


def wav_ok(spec: DataFrame) -> DataFrame:
    """Recordings (rate, channels, bits, samples, expected) that have the expected format and length."""
    return spec.filter("rate = 16000 AND channels = 1 AND bits = 16 AND samples = expected")


def model_paths(listing: DataFrame) -> DataFrame:
    """Regular, visible model files of a listing (path, is_file)."""
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return listing.filter(F.col("is_file") & ~name.startswith(".") & (name.endswith(".bin") | name.endswith(".gguf"))).select("path", name.alias("filename"))


def hub_cache(listing: DataFrame) -> DataFrame:
    """(repo_id, commit) of a hub cache listing of refs (folder, ref, commit): the ref main if there is one, else the first by name."""
    repos = listing.filter(F.col("folder").startswith("models--")).withColumn("repo_id", F.regexp_replace(F.regexp_replace("folder", "^models--", ""), "--", "/"))
    return repos.groupBy("repo_id").agg(F.min_by("commit", F.struct(F.col("ref") != "main", "ref")).alias("commit"))


def remote_models(content) -> Column:
    """The model names of an answer {data: [{id | name}]} or [name]."""
    v = F.try_parse_json(_c(content))
    data = F.coalesce(F.try_variant_get(v, "$.data", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    name = lambda x: F.coalesce(F.try_variant_get(x, "$.id", "string"), F.try_variant_get(x, "$.name", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    return F.filter(F.transform(data, name), lambda x: x.isNotNull())


def run_json(*columns: str) -> Column:
    """A run's columns as one JSON text."""
    return F.to_json(F.struct(*columns))


def model_lines(rows: DataFrame) -> DataFrame:
    """A line for each model: id padded to the longest, then the name."""
    width = rows.agg(F.max(F.length("model_id")).alias("_w"))
    return rows.join(F.broadcast(width)).select("model_id", F.concat(F.rpad("model_id", F.col("_w"), F.lit(" ")), F.lit("  "), F.col("name")).alias("line"))  # one row


def digest_ok(content, expected) -> Column:
    """Whether a file's bytes have the expected digest; none expected accepts."""
    return _c(expected).isNull() | (F.sha2(_c(content), 256) == F.lower(_c(expected)))
