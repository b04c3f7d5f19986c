"""Queries of the model registry, catalogs, audits and settings."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import catalog as c
from voxloom.operators import registry as r
from voxloom.operators import settings as s
from voxloom.operators.ranking import placed
from voxloom.plans.base import registrar
from voxloom.sources import documents as sources
from voxloom.sources import media
from voxloom.sources.tables import table

QUERIES, ORACLES, query = registrar()

#: The part table read as models; the expressions are the same in both dialects.
MODEL = {
    "model_id": "'m' || p_partkey", "repo_id": "p_brand", "filename": "'f' || (p_partkey % 97) || '.gguf'", "name": "p_name", "description": "p_type", "accuracy": "p_size", "speed": "p_partkey % 7", "is_recommended": "p_size <= 5",
    "rank_of": "CASE WHEN p_size % 10 = 0 THEN p_size ELSE 4294967295 END", "is_downloaded": "p_partkey % 3 = 0", "is_downloading": "p_partkey % 11 = 0", "is_custom": "p_partkey % 13 = 0", "is_legacy": "p_partkey % 5 = 0",
    "is_default": "p_partkey % 4 <> 0", "is_discovered": "p_partkey % 6 = 0", "streaming": "p_partkey % 2 = 0", "translate": "p_partkey % 6 = 0", "pos": "p_partkey",
}
MODELS_SQL = "models AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in MODEL.items()) + ", string_split(CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de,en-GB' ELSE 'zh-Hans,no' END, ',') AS languages FROM part)"


def models(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr(*[f"{e} AS {n}" for n, e in MODEL.items()], "split(CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de,en-GB' ELSE 'zh-Hans,no' END, ',') AS languages")
    return rows


WITH = f"WITH {MODELS_SQL} "

#: A catalog with a model for each part, by the same expressions in both dialects; some files have the name of another model's.
CATALOG_COLUMNS = {
    "ord": "k", "id": "'org/model-' || k", "revision": "CASE WHEN k % 9 > 0 THEN 'rev' || k END", "slug": "'model-' || k", "name": "'Model ' || k", "description": "'About ' || k",
    "speed_score": "k % 101", "accuracy_score": "CASE WHEN k % 4 > 0 THEN 90 - k % 90 END", "recommended": "k % 5 = 0", "recommended_rank": "CASE WHEN k % 5 = 0 THEN k END", "default_quant": "CASE WHEN k % 7 = 0 THEN 'Q4' ELSE 'Q8_0' END",
}
FILES = {"filename": "'model-' || (k - k % 2) || '-' || q || '.gguf'", "quant": "q", "size_bytes": "1048576 * (k + 1) * (j + 1) + 17", "sha256": "CASE WHEN k % 11 > 0 THEN sha256('x' || k || q) END"}
CAT_SQL = "cat AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CATALOG_COLUMNS.items()) + " FROM (SELECT p_partkey AS k FROM part))"
FILES_SQL = "files AS (SELECT k AS ord, j AS file_ord, 'org/model-' || k AS id, " + ", ".join(f"{e} AS {n}" for n, e in FILES.items()) + " FROM (SELECT p_partkey AS k FROM part), (VALUES (0, 'F16'), (1, 'Q8_0'), (2, 'Q5_K_M')) AS u(j, q))"


def catalog(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "part").selectExpr("p_partkey AS k")
    quants = "(CASE j WHEN 0 THEN 'F16' WHEN 1 THEN 'Q8_0' ELSE 'Q5_K_M' END)"
    one = lambda j: "named_struct(" + ", ".join(f"'{n}', {e.replace('sha256(', 'sha2(').replace('|| k || q)', '|| k || q, 256)').replace(' q', ' ' + quants) if n != 'quant' else quants}" for n, e in FILES.items()) + ")"
    files = "transform(array(0, 1, 2), j -> " + one(0) + ")"
    files = files.replace("k || q, 256", f"k || {quants}, 256").replace("|| q ||", f"|| {quants} ||")
    return base.selectExpr(*[f"{e} AS {n}" for n, e in CATALOG_COLUMNS.items()], f"{files} AS files", "array('en') AS languages", "'whisper' AS architecture")


CAT = f"WITH {CAT_SQL}, {FILES_SQL} "


@query("r1_default_file", CAT + "SELECT cat.id, coalesce((SELECT min_by(filename, file_ord) FROM files f WHERE f.id = cat.id AND f.quant = cat.default_quant), (SELECT min_by(filename, file_ord) FROM files f WHERE f.id = cat.id)) AS filename FROM cat")
def r1(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("id", r.default_file()["filename"].alias("filename"))


@query("r2_descriptors", CAT + "SELECT f.id || '/' || filename AS model_id, revision, quant, size_bytes, CAST(coalesce(accuracy_score, 0) AS FLOAT) / CAST(100 AS FLOAT) AS accuracy, recommended, recommended_rank AS rank, f.ord, f.file_ord FROM files f JOIN cat ON f.id = cat.id")
def r2(spark: SparkSession, d: str) -> DataFrame:
    return r.descriptors(catalog(spark, d)).select("model_id", "revision", "quant", "size_bytes", "accuracy", "recommended", "rank", "ord", F.col("file_ord").cast("int").alias("file_ord"))


DEFAULT = "CASE WHEN default_quant = 'Q4' THEN f.file_ord = 0 ELSE f.quant = 'Q8_0' END"


@query("r3_models", CAT + f"SELECT f.id || '/' || filename AS model_id, CASE WHEN {DEFAULT} THEN name ELSE name || ' (' || quant || ')' END AS name, size_bytes // 1048576 AS size_mb, f.ord % 2 = 0 AS is_downloaded, recommended AND {DEFAULT} AS is_recommended FROM files f JOIN cat ON f.id = cat.id")
def r3(spark: SparkSession, d: str) -> DataFrame:
    rows = r.descriptors(catalog(spark, d))
    status = rows.filter("ord % 2 = 0").select("model_id", F.lit(True).alias("is_downloaded"), F.lit(False).alias("is_downloading"))
    return r.models(rows, status).select("model_id", "name", "size_mb", "is_downloaded", "is_recommended")


@query("r4_find_catalog_file", CAT + "SELECT w.filename, min_by(f.id, (f.ord, f.file_ord)) AS repo FROM (SELECT DISTINCT 'model-' || (p_partkey * 3) || '-Q8_0.gguf' AS filename FROM part) w JOIN files f USING (filename) GROUP BY w.filename")
def r4(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "part").selectExpr("'model-' || (p_partkey * 3) || '-Q8_0.gguf' AS filename", "CAST(NULL AS STRING) AS repo_id").distinct()
    return r.found_files(wanted, catalog(spark, d)).select("filename", F.col("cat_repo").alias("repo"))


@query("r5_mirror_urls", CAT + "SELECT f.id || '/' || filename AS model_id, mirror_ord, base || '/' || f.id || '/' || revision || '/' || filename AS url FROM files f JOIN cat ON f.id = cat.id, (VALUES (0, 'https://a.example'), (1, 'https://b.example/x')) AS m(mirror_ord, base) WHERE revision IS NOT NULL AND sha256 IS NOT NULL")
def r5(spark: SparkSession, d: str) -> DataFrame:
    mirrors = spark.createDataFrame([(0, "https://a.example/"), (1, "https://b.example/x//")], "mirror_ord int, base string")
    return r.mirror_urls(r.descriptors(catalog(spark, d)), mirrors)


@query("r6_rank_of", CAT + "SELECT p_partkey, coalesce(CAST(recommended_rank AS BIGINT), 4294967295) AS rank_of FROM part LEFT JOIN cat ON cat.id = 'org/model-' || (p_partkey * 5)")
def r6(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "'org/model-' || (p_partkey * 5) AS repo_id")
    return r.ranked(rows, catalog(spark, d)).select("p_partkey", "rank_of")


@query("r7_registry_order", WITH + "SELECT model_id, row_number() OVER (ORDER BY rank_of, is_recommended DESC, accuracy DESC, speed DESC, name, model_id) AS place FROM models")
def r7(spark: SparkSession, d: str) -> DataFrame:
    return r.places(models(spark, d)).select("model_id", "place")


KNOWN = "(SELECT 'm' || (s_suppkey * 3) AS model_id, s_name AS name FROM supplier)"


@query("r8_merge_existing_wins", WITH + f"SELECT model_id, name FROM {KNOWN} UNION ALL SELECT model_id, name FROM models WHERE model_id NOT IN (SELECT model_id FROM {KNOWN})")
def r8(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "supplier").selectExpr("'m' || (s_suppkey * 3) AS model_id", "s_name AS name")
    return r.merged(known, models(spark, d).select("model_id", "name"))


@query("r9_skip_known", WITH + "SELECT model_id FROM models WHERE (repo_id, filename) NOT IN (SELECT repo_id, filename FROM models WHERE is_legacy)")
def r9(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    return r.unknown(m, m.filter("is_legacy"), ["repo_id", "filename"]).select("model_id")


FOUND = "found AS (SELECT p_partkey, 'model-' || p_partkey || '-F16.gguf' AS filename, CASE WHEN p_partkey % 2 = 0 THEN 'cache' ELSE 'own' END AS place FROM part), probes AS (SELECT 'model-' || k || '-F16.gguf' AS filename, CASE k % 3 WHEN 0 THEN 'whisper' WHEN 1 THEN 'other' END AS arch FROM (SELECT p_partkey AS k FROM part WHERE p_size % 4 > 0))"


@query("r10_classify_found", CAT + f", {FOUND}, names AS (SELECT filename, min_by('Model ' || ord, ord) AS n FROM files GROUP BY filename), j AS (SELECT p_partkey, place, coalesce(n, found.filename) AS name, CASE WHEN n IS NOT NULL THEN 'catalog' ELSE 'probe' END AS origin, CASE WHEN n IS NOT NULL OR arch = 'whisper' THEN 'compatible' WHEN arch IS NULL THEN 'unknown' ELSE 'incompatible' END AS verdict FROM found LEFT JOIN names USING (filename) LEFT JOIN probes USING (filename)) SELECT p_partkey, name, origin, verdict FROM j WHERE place <> 'cache' OR verdict = 'compatible'")
def r10(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "part").selectExpr("p_partkey", "'model-' || p_partkey || '-F16.gguf' AS filename", "CASE WHEN p_partkey % 2 = 0 THEN 'cache' ELSE 'own' END AS place")
    probes = table(spark, d, "part").filter("p_size % 4 > 0").selectExpr("'model-' || p_partkey || '-F16.gguf' AS filename", "CASE p_partkey % 3 WHEN 0 THEN 'whisper' WHEN 1 THEN 'other' END AS arch")
    return r.classified(found, catalog(spark, d), probes).select("p_partkey", "name", "origin", "verdict")


@query("r11_refresh_status", WITH + "SELECT model_id, filename IN (SELECT 'f' || s_suppkey || '.gguf' FROM supplier WHERE s_suppkey % 2 = 0) AS is_downloaded FROM models WHERE filename IN (SELECT 'f' || s_suppkey || '.gguf' FROM supplier WHERE s_suppkey % 2 = 0) OR is_downloading OR NOT (is_custom OR NOT is_default)")
def r11(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").selectExpr("'f' || s_suppkey || '.gguf' AS filename")
    return r.refreshed(models(spark, d), listing).select("model_id", "is_downloaded")


@query("r12_runtime_capabilities", WITH + "SELECT model_id, CASE WHEN pos % 10 = 0 THEN 'fr' ELSE array_to_string(languages, ',') END AS langs, CASE WHEN pos % 5 = 0 THEN true ELSE translate END AS translate FROM models")
def r12(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    runtime = m.filter("pos % 5 = 0").selectExpr("model_id", "CASE WHEN pos % 10 = 0 THEN array('fr') ELSE CAST(array() AS array<string>) END AS rt_languages", "true AS rt_translate")
    return r.with_runtime(m, runtime).select("model_id", F.array_join("languages", ",").alias("langs"), "translate")


for _name, _current, _onboarded in (("kept", "m3", True), ("picked", "m4", True), ("cleared", "m4", False)):

    @query(f"r13_selection_{_name}", WITH + {"kept": "SELECT 'm3' AS model_id", "picked": "SELECT model_id FROM models WHERE is_downloaded ORDER BY rank_of, is_recommended DESC, accuracy DESC, speed DESC, name LIMIT 1", "cleared": "SELECT '' AS model_id"}[_name])
    def r13(spark: SparkSession, d: str, current: str = _current, onboarded: bool = _onboarded) -> DataFrame:
        return r.selected(models(spark, d), current, onboarded)


ARCHES = "[" + ", ".join(f"'{a}'" for a in r.KNOWN_ARCHES) + "]"
ARCH = "CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN p_type ELSE {arches}[p_partkey % {n} + {first}] END"


@query("r14_arch_verdict", f"SELECT p_partkey, CASE WHEN arch IS NULL THEN 'unknown' WHEN list_contains({ARCHES}, arch) THEN 'compatible' ELSE 'incompatible' END AS verdict FROM (SELECT p_partkey, {ARCH.format(arches=ARCHES, n=len(r.KNOWN_ARCHES), first=1)} AS arch FROM part)")
def r14(spark: SparkSession, d: str) -> DataFrame:
    arch = F.expr(ARCH.format(arches="array(" + ARCHES[1:-1] + ")", n=len(r.KNOWN_ARCHES), first=0))
    return table(spark, d, "part").select("p_partkey", r.verdict(arch).alias("verdict"))


@query("r15_local_capabilities", WITH + "SELECT model_id AS filename, coalesce(CASE WHEN pos % 4 > 0 THEN translate END, false) AS translate, len(languages) > 1 AS can_choose_language FROM models")
def r15(spark: SparkSession, d: str) -> DataFrame:
    probes = models(spark, d).selectExpr("model_id AS filename", "CASE WHEN pos % 4 > 0 THEN translate END AS translate", "CAST(NULL AS BOOLEAN) AS lang_detect", "streaming", "languages")
    return r.local_capabilities(probes).select("filename", "translate", "can_choose_language")


@query("r16_filtered_models", WITH + "SELECT model_id FROM models WHERE (NOT is_legacy OR is_downloaded) AND len(list_filter(languages, lambda x: regexp_extract(x, '^[^-_]*') = 'en')) > 0 AND streaming AND contains(lower(name || ' ' || description), 'e')")
def r16(spark: SparkSession, d: str) -> DataFrame:
    return r.filtered(models(spark, d), language="en", streaming=True, query=" E").select("model_id")


@query("r17_sections", WITH + "SELECT model_id, CASE WHEN is_downloaded OR is_custom THEN 'downloaded' ELSE 'available' END AS section FROM models")
def r17(spark: SparkSession, d: str) -> DataFrame:
    return r.sectioned(models(spark, d), "m3").select("model_id", "section")


@query("r18_status", WITH + "SELECT model_id, CASE WHEN pos % 19 = 0 THEN 'extracting' WHEN pos % 17 = 0 THEN 'verifying' WHEN is_downloading THEN 'downloading' WHEN pos % 23 = 0 THEN 'switching' WHEN NOT is_downloaded THEN 'downloadable' WHEN model_id = 'm9' THEN 'active' ELSE 'available' END AS status FROM models")
def r18(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d).selectExpr("*", "pos % 19 = 0 AS is_extracting", "pos % 17 = 0 AS is_verifying", "pos % 23 = 0 AS is_switching")
    return m.select("model_id", r.status("m9").alias("status"))


@query("r19_devices", "SELECT 'Default' AS name UNION ALL SELECT CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE s_name || '!' END FROM supplier WHERE s_suppkey % 10 > 0")
def r19(spark: SparkSession, d: str) -> DataFrame:
    devices = table(spark, d, "supplier").selectExpr("CASE WHEN s_suppkey % 10 = 0 THEN 'default' WHEN s_suppkey % 4 = 0 THEN s_name ELSE s_name || '!' END AS name", "s_suppkey AS pos")
    return r.with_default_device(devices).select("name")


@query("r20_distinct_union", WITH + "SELECT model_id, len(list_distinct(list_concat(languages, ['en', 'xx']))) AS n FROM models")
def r20(spark: SparkSession, d: str) -> DataFrame:
    return models(spark, d).select("model_id", r.distinct_count("languages", F.array(F.lit("en"), F.lit("xx"))).cast("long").alias("n"))


@query("r21_language_filter", "SELECT n_name AS label FROM nation WHERE contains(lower(n_name), 'an')")
def r21(spark: SparkSession, d: str) -> DataFrame:
    return r.matching_languages(table(spark, d, "nation").select(F.col("n_name").alias("label")), "AN")


@query("r22_ui_language_order", "SELECT name, priority, row_number() OVER (ORDER BY priority NULLS LAST, lower(name)) AS place FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_nationkey % 9 = 0 THEN n_nationkey END AS priority FROM nation)")
def r22(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").selectExpr("CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name", "CASE WHEN n_nationkey % 9 = 0 THEN n_nationkey END AS priority")
    return r.ui_languages(rows)


PATHS = "SELECT p_partkey AS model_id, CASE WHEN p_partkey % 2 = 0 THEN 'hub' ELSE 'url' END AS kind, p_partkey % 13 > 0 AS is_known, p_partkey % 3 > 0 AS is_downloaded, p_partkey % 11 = 0 AS is_downloading, CASE WHEN p_partkey % 4 = 0 THEN 'c' END AS cached_path, CASE WHEN p_partkey % 5 = 0 THEN 'm' END AS main_path, CASE WHEN p_partkey % 7 > 0 THEN 'l' END AS local_path, CASE WHEN p_partkey % 6 = 1 THEN 'p' END AS partial_path FROM part"


@query("r23_resolved_paths", f"WITH t AS ({PATHS}), u AS (SELECT *, CASE WHEN kind = 'hub' THEN coalesce(cached_path, main_path, local_path) WHEN partial_path IS NULL THEN local_path END AS p FROM t), v AS (SELECT *, CASE WHEN NOT is_known THEN 'unknown' WHEN NOT is_downloaded THEN 'not downloaded' WHEN is_downloading THEN 'downloading' WHEN p IS NULL THEN 'missing' END AS error FROM u) SELECT model_id, CASE WHEN error IS NULL THEN p END AS path, error FROM v")
def r23(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("voxloom_part")
    return r.resolved_paths(spark.sql(PATHS.replace("FROM part", "FROM voxloom_part")))


@query("r24_delete_repo", WITH + "SELECT model_id FROM models WHERE model_id <> 'm5' AND repo_id <> (SELECT repo_id FROM models WHERE model_id = 'm5')")
def r24(spark: SparkSession, d: str) -> DataFrame:
    return r.after_delete(models(spark, d), "m5").select("model_id")


@query("r24_delete_alternate", WITH + "SELECT model_id FROM models WHERE model_id <> 'm8'")
def r24a(spark: SparkSession, d: str) -> DataFrame:
    return r.after_delete(models(spark, d), "m8").select("model_id")


@query("r25_mark_unavailable", WITH + "SELECT model_id, is_downloaded AND model_id <> 'm9' AS is_downloaded FROM models WHERE NOT (model_id = 'm9' AND is_discovered)")
def r25(spark: SparkSession, d: str) -> DataFrame:
    return r.marked_unavailable(models(spark, d), "m9").select("model_id", "is_downloaded")


@query("f1_speed_score", "SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 10 ELSE CAST(round_even(100 * (1 - exp(-(p_size % 9) / 8.0)), 0) AS INT) END AS speed FROM part")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", c.speed_score(F.expr("nullif(p_size % 9, 0)")).alias("speed"))


@query("f2_accuracy_score", "SELECT p_partkey, CAST(round_even(100 * exp(-p_size / 15.0), 0) AS INT) AS accuracy FROM part")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", c.accuracy_score("p_size").alias("accuracy"))


@query("f3_headline_figures", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 2.5 ELSE 7.0 END AS rtf, CASE p_size % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 WHEN 2 THEN 3.0 END AS wer FROM part")
def f3(spark: SparkSession, d: str) -> DataFrame:
    rtf = F.expr("CASE p_size % 3 WHEN 0 THEN map('vulkan', CAST(NULL AS DOUBLE), 'cpu', 9.0D) WHEN 1 THEN map('cpu', 2.5D) ELSE map('vulkan', 7.0D, 'cpu', 1.0D) END")
    wer = F.expr("""CASE p_size % 4 WHEN 0 THEN map('wer_fleurs_en', map('q8_0', 9.0D), 'wer_librispeech_test_clean', map('bf16', 8.0D, 'q8_0', 1.5D))
        WHEN 1 THEN map('wer_fleurs_de', map('q8_0', 9.0D), 'wer_fleurs_en', map('f32', 2.0D)) WHEN 2 THEN map('other', map('q8_0', 9.0D), 'wer_fleurs_fr', map('f16', 3.0D)) ELSE map('wer_fleurs_en', map('zz', 1.0D)) END""")
    return table(spark, d, "part").select("p_partkey", c.benchmark_rtf(rtf).alias("rtf"), c.headline_wer(wer).alias("wer"))


@query("f4_quant_and_size", CAT + "SELECT f.id, f.quant, CASE ord % 3 WHEN 0 THEN 0.6 WHEN 1 THEN 0.062 END AS billions FROM files f")
def f4(spark: SparkSession, d: str) -> DataFrame:
    files = r.descriptors(catalog(spark, d))
    label = F.expr("CASE ord % 3 WHEN 0 THEN '0.6B' WHEN 1 THEN ' 62m' ELSE 'big' END")
    return files.select(F.col("repo_id").alias("id"), c.quant_of("filename").alias("quant"), c.billions(label).alias("billions"))


@query("f5_default_quant", CAT + "SELECT id, CASE WHEN ord % 7 = 0 THEN 'F16' WHEN ord % 2 = 0 THEN 'Q5_K_M' ELSE 'Q8_0' END AS quant FROM cat")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("id", c.default_quant("files", F.expr("CASE WHEN ord % 2 = 0 THEN '1.7B' ELSE '62M' END"), F.expr("CASE WHEN ord % 7 = 0 THEN 'F16' END")).alias("quant"))


SLUGS = "lower(replace(p_name, ' ', '-')) || CASE p_size % 5 WHEN 0 THEN '-Moonshine-Streaming-x' WHEN 1 THEN '-canary-qwen' WHEN 2 THEN '-Whisper-Canary' WHEN 3 THEN '-x-qwen3' ELSE '' END"


def _list(names, start: str, end: str) -> str:
    return start + ", ".join(f"'{n}'" for n in names) + end


@query(
    "f6_family",
    f"""SELECT p_partkey, coalesce(string_split(list_filter({_list(c.FAMILIES, '[', ']')}, lambda f: contains(lower({SLUGS}), f))[1], '-')[1], CASE WHEN p_size % 7 = 2 THEN 'voxtral' WHEN p_size % 7 = 3 THEN 'granite' END, 'other') AS family FROM part""",
)
def f6(spark: SparkSession, d: str) -> DataFrame:
    tags = F.expr("CASE p_size % 7 WHEN 2 THEN array('x', 'voxtral') WHEN 3 THEN array('granite', 'y') ELSE array('x') END")
    return table(spark, d, "part").select("p_partkey", c.family(F.expr(SLUGS), tags).alias("family"))


@query("f7_model_files", CAT + "SELECT id AS repo, string_agg(filename, ',' ORDER BY size_bytes) AS names FROM files WHERE sha256 IS NOT NULL GROUP BY id")
def f7(spark: SparkSession, d: str) -> DataFrame:
    listing = r.descriptors(catalog(spark, d)).filter("sha256 IS NOT NULL").select(F.col("repo_id").alias("repo"), "filename", "size_bytes", "sha256")
    return c.model_files(listing).select("repo", F.array_join(F.transform("files", lambda f: f["filename"]), ",").alias("names"))


@query("f8_descriptions", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '2-language speech-to-text' WHEN 1 THEN 'Korean speech-to-text' WHEN 2 THEN 'xx speech-to-text' ELSE 'English speech-to-text' END || CASE WHEN p_size % 2 = 0 THEN ' with translation, word-level timestamps.' ELSE '.' END AS description, 'Big ASR ' || p_size || 'b XY Rest' AS name FROM part")
def f8(spark: SparkSession, d: str) -> DataFrame:
    langs = F.expr("CASE p_size % 4 WHEN 0 THEN array('en', 'de') WHEN 1 THEN array('ko') WHEN 2 THEN array('xx') ELSE CAST(array() AS array<string>) END")
    caps = F.expr("named_struct('translate', p_size % 2 = 0, 'lang_detect', false, 'streaming', CAST(NULL AS BOOLEAN), 'timestamps', CASE WHEN p_size % 2 = 0 THEN 'word' ELSE 'none' END)")
    return table(spark, d, "part").select("p_partkey", c.auto_description(langs, caps).alias("description"), c.pretty_name(F.expr("'big-asr-' || p_size || 'b-XY-rEST'")).alias("name"))


@query("f9_visible", CAT + "SELECT id FROM cat WHERE slug NOT IN ('model-3', 'model-4')")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return c.visible(catalog(spark, d), ("model-3", "model-4")).select("id")


@query("f10_catalog_order", CAT + "SELECT id, row_number() OVER (ORDER BY recommended DESC, CASE WHEN coalesce(recommended_rank, 0) = 0 THEN 1e9 ELSE recommended_rank END, slug[1:7], speed_score DESC, slug) AS place FROM cat")
def f10(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog(spark, d).withColumn("family", F.substring("slug", 1, 7))
    return placed(rows, c.catalog_order()).select("id", "place")


OBJECTS = "objects AS (SELECT f.id || '/rev' || ord || '/' || filename AS key, CASE WHEN ord % 5 = 0 THEN 'bad' ELSE sha256 END AS sha256 FROM files f WHERE ord % 3 = 0 UNION ALL SELECT f.id || '/old/' || filename, sha256 FROM files f WHERE ord % 4 = 0)"


@query(
    "f11_mirror_tally",
    CAT + f""", {OBJECTS}, j AS (SELECT f.id || '/rev' || ord || '/' || filename AS key, * FROM files f WHERE sha256 IS NOT NULL),
    a AS (SELECT size_bytes, CASE WHEN o.key IS NOT NULL AND o.sha256 = j.sha256 THEN 'skip' WHEN o.key IS NOT NULL THEN 'mismatch' WHEN ord % 4 = 0 THEN 'copy' ELSE 'upload' END AS action FROM j LEFT JOIN objects o USING (key))
    SELECT action, count(*) AS files, CAST(sum(CASE WHEN action = 'upload' THEN size_bytes ELSE 0 END) AS BIGINT) AS upload_bytes FROM a GROUP BY action""",
)
def f11(spark: SparkSession, d: str) -> DataFrame:
    files = r.descriptors(catalog(spark, d))
    key = lambda rev: F.concat_ws("/", "repo_id", rev, "filename").alias("key")
    now = F.concat(F.lit("rev"), F.col("ord").cast("string"))
    objects = files.filter("ord % 3 = 0").select(key(now), F.when(F.col("ord") % 5 == 0, "bad").otherwise(F.col("sha256")).alias("sha256")).unionByName(files.filter("ord % 4 = 0").select(key(F.lit("old")), "sha256"))
    wanted = files.filter("sha256 IS NOT NULL").select(key(now), F.col("repo_id").alias("repo"), "filename", "sha256", "size_bytes")
    return c.mirror_tally(c.mirror_plan(wanted, objects))


@query("f12_verify_objects", "SELECT count(*) FILTER (WHERE s_suppkey % 5 = 0) AS missing, count(*) FILTER (WHERE s_suppkey % 5 > 0 AND s_suppkey % 7 = 0) AS bad, count(*) FILTER (WHERE s_suppkey % 5 > 0 AND s_suppkey % 7 > 0) AS ok FROM supplier")
def f12(spark: SparkSession, d: str) -> DataFrame:
    sup = table(spark, d, "supplier")
    wanted = sup.selectExpr("s_suppkey AS key", "sha2(s_name, 256) AS sha256")
    stored = sup.filter("s_suppkey % 5 > 0").selectExpr("s_suppkey AS key", "CAST(CASE WHEN s_suppkey % 7 = 0 THEN 'x' ELSE s_name END AS BINARY) AS content")
    return c.verified(wanted, stored)


KEYS = "SELECT lang, key_path FROM (SELECT 'en' AS lang, 'n.' || n_nationkey AS key_path, n_nationkey AS k FROM nation UNION ALL SELECT 'de', 'n.' || n_nationkey, n_nationkey + 1 FROM nation UNION ALL SELECT 'fr', 'n.' || (n_nationkey + 5), n_nationkey + 1 FROM nation) t WHERE lang = 'en' OR k % 6 > 0"


@query("f13_translation_audit", f"WITH k AS ({KEYS}), l AS (SELECT DISTINCT lang FROM k WHERE lang <> 'en') SELECT l.lang, e.key_path, 'missing' AS problem FROM l, k e WHERE e.lang = 'en' AND NOT EXISTS (SELECT 1 FROM k WHERE k.lang = l.lang AND k.key_path = e.key_path) UNION ALL SELECT lang, key_path, 'extra' FROM k WHERE lang <> 'en' AND key_path NOT IN (SELECT key_path FROM k WHERE lang = 'en')")
def f13(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "nation").createOrReplaceTempView("voxloom_nation")
    return c.translation_audit(spark.sql(KEYS.replace("FROM nation", "FROM voxloom_nation")))


@query(
    "f13_flatten_translations",
    """SELECT n_nationkey AS lang, 'a.b' AS key_path FROM nation UNION ALL SELECT n_nationkey, 'a.c.d' FROM nation UNION ALL SELECT n_nationkey, 'e' FROM nation
    UNION ALL SELECT n_nationkey, replace(n_name, ' ', '_') || repeat('.x', n_nationkey % 11) FROM nation""",
)
def f13f(spark: SparkSession, d: str) -> DataFrame:
    """Documents of up to eleven levels, each with a key of its own."""
    deep = "'\"' || replace(n_name, ' ', '_') || '\": ' || repeat('{\"x\": ', n_nationkey % 11) || '0' || repeat('}', n_nationkey % 11)"
    docs = table(spark, d, "nation").selectExpr("n_nationkey AS lang", """'{"a": {"b": "' || n_name || '", "c": {"d": 1}}, "e": [1, 2], ' || """ + deep + " || '}' AS content")
    return c.flattened(docs)


INTENTS = "SELECT CASE n_nationkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'nb' WHEN 2 THEN 'no' ELSE 'zh-Hans' END AS code"
BASE = "CASE split_part({0}, '-', 1) WHEN 'nb' THEN 'no' WHEN 'fil' THEN 'tl' ELSE split_part({0}, '-', 1) END"


@query("f14_language_coverage", f"WITH {MODELS_SQL}, intents AS (SELECT DISTINCT code FROM ({INTENTS} FROM nation)), found AS (SELECT language, count(code) AS matches FROM (SELECT DISTINCT unnest(languages) AS language FROM models) LEFT JOIN intents ON {BASE.format('code')} = {BASE.format('language')} GROUP BY language) SELECT * FROM found WHERE matches <> 1")
def f14(spark: SparkSession, d: str) -> DataFrame:
    intents = table(spark, d, "nation").selectExpr(INTENTS.removeprefix("SELECT "))
    return c.language_coverage(models(spark, d), intents)


@query("f15_catalog_invariants", CAT + "SELECT DISTINCT id, 'bad digest' AS breach FROM files WHERE sha256 IS NULL")
def f15(spark: SparkSession, d: str) -> DataFrame:
    return c.invariant_breaches(catalog(spark, d))


#: A header of string, flag, number and list values; parts with a long one need a larger prefix than the first.
def header(key: int, name: str) -> bytes:
    text = lambda t: struct.pack("<Q", len(t.encode())) + t.encode()
    pairs = [("general.architecture", 8, text("whisper" if key % 2 else "other")), ("x.tokens", 9, struct.pack("<IQ", 8, 2) + text("t" * (50_000 if key % 50 == 0 else 5)) * 2)]
    pairs += [("general.name", 8, text(name)), ("stt.capability.streaming", 7, struct.pack("<?", key % 3 == 0)), ("general.languages", 9, struct.pack("<IQ", 8, 2) + text("en") + text("de"))]
    magic = b"GGUF" if key % 7 else b"GGUX"
    return magic + struct.pack("<IQQ", 3, 0, len(pairs)) + b"".join(text(k) + struct.pack("<I", kind) + value for k, kind, value in pairs)


@query(
    "k7_k9_header_probe",
    """SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN ok THEN p_name END AS name, CASE WHEN ok THEN CASE WHEN p_partkey % 2 = 1 THEN 'whisper' ELSE 'other' END END AS arch, CASE WHEN ok THEN 'en,de' END AS languages,
    CASE WHEN ok THEN p_partkey % 3 = 0 END AS streaming, NOT ok AS failed FROM (SELECT *, p_partkey % 7 > 0 AS ok FROM part)""",
)
def k7(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("binary")
    def content(keys: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([header(k, n) for k, n in zip(keys, names, strict=True)])

    files = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), content("p_partkey", "p_name").alias("content"))
    return media.probed(files).select("path", "name", "arch", F.array_join("languages", ",").alias("languages"), "streaming", F.col("error").isNotNull().alias("failed"))


@query("k16_settings_round_trip", "SELECT s_suppkey, s_name AS selected_model, s_suppkey % 2 = 0 AS debug_mode, 5 AS history_limit FROM supplier")
def k16(spark: SparkSession, d: str) -> DataFrame:
    """Settings written as one JSON document and read again."""
    rows = table(spark, d, "supplier").selectExpr("s_suppkey", "s_name AS selected_model", "s_suppkey % 2 = 0 AS debug_mode")
    stored = rows.select("s_suppkey", c.run_json("selected_model", "debug_mode").alias("content"))
    return s.salvaged(stored).select("s_suppkey", "selected_model", "debug_mode", "history_limit")


@query("k6_catalog_scan", "SELECT n_nationkey, k AS ord, 'm' || k AS id, n_name AS name, k * 7 AS speed_score, 'a.gguf' AS first_file FROM nation, range(0, 2) AS t(k)")
def k6(spark: SparkSession, d: str) -> DataFrame:
    one = lambda k: f'''{{"id": "m{k}", "unknown": [1], "name": "' || n_name || '", "speed_score": {k * 7}, "files": [{{"filename": "a.gguf", "quant": "Q8_0", "size_bytes": 5, "sha256": "x", "more": 1}}]}}'''
    content = F.expr(f"""'{{"catalog_version": 1, "other": {{}}, "mirrors": ["https://a.example"], "models": [{one(0)}, {one(1)}]}}'""")
    docs = table(spark, d, "nation").select("n_nationkey", sources.parsed_catalog(content).alias("c"))
    rows = docs.select("n_nationkey", F.posexplode("c.models").alias("ord", "m"))
    return rows.select("n_nationkey", "ord", "m.id", "m.name", "m.speed_score", F.col("m.files")[0]["filename"].alias("first_file"))


@query("k13_wav_gate", "SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 = 0")
def k13(spark: SparkSession, d: str) -> DataFrame:
    spec = table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_size % 2 = 0 THEN 16000 ELSE 44100 END AS rate", "1 AS channels", "16 AS bits", "p_partkey AS samples", "CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE 1 END AS expected")
    return c.wav_ok(spec.filter("NOT (p_partkey = 1)")).select("p_partkey")


@query("k14_model_paths", "SELECT '/models/' || CASE WHEN p_partkey % 7 = 0 THEN '.' ELSE '' END || p_partkey || CASE p_size % 3 WHEN 0 THEN '.gguf' WHEN 1 THEN '.bin' ELSE '.partial' END AS path FROM part WHERE p_partkey % 7 > 0 AND p_size % 3 < 2")
def k14(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "part").selectExpr("'/models/' || CASE WHEN p_partkey % 7 = 0 THEN '.' ELSE '' END || p_partkey || CASE p_size % 3 WHEN 0 THEN '.gguf' WHEN 1 THEN '.bin' ELSE '.partial' END AS path", "true AS is_file")
    return c.model_paths(listing).select("path")


REFS = """SELECT CASE WHEN n_nationkey % 6 = 5 THEN 'x' ELSE '' END || 'models--org--r' || n_nationkey % 9 AS folder, CASE WHEN n_nationkey % 4 = 0 THEN 'main' ELSE 'ref' || n_name END AS ref, 'c' || n_nationkey AS "commit" FROM nation"""


@query("k15_hub_cache", f"SELECT replace(replace(folder, 'models--', ''), '--', '/') AS repo_id, arg_min(\"commit\", CASE WHEN ref = 'main' THEN '0' ELSE '1' || ref END) AS \"commit\" FROM ({REFS}) WHERE folder LIKE 'models--%' GROUP BY folder")
def k15(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "nation").createOrReplaceTempView("voxloom_nation")
    return c.hub_cache(spark.sql(REFS.replace("FROM nation", "FROM voxloom_nation").replace('"commit"', "`commit`")))


ANSWERS = """CASE n_nationkey % 5 WHEN 0 THEN '{"data": [{"id": "a"}, {"name": "' || n_name || '"}, {"x": 1}]}' WHEN 1 THEN '["' || n_name || '", "z"]' WHEN 2 THEN '{"data": [{"id": "' || n_name || '", "name": "other"}]}'
 WHEN 3 THEN '["a", 5, {"name": "' || n_name || '"}]' ELSE '{"data": []}' END"""


@query(
    "k17_remote_models",
    f"""SELECT n_nationkey, coalesce(list_aggregate(list_filter(list_transform(CAST(CASE json_type(c) WHEN 'OBJECT' THEN c->'$.data' ELSE c END AS JSON[]),
      lambda x: CASE json_type(x) WHEN 'OBJECT' THEN coalesce(x->>'$.id', x->>'$.name') WHEN 'VARCHAR' THEN x->>'$' END), lambda x: x IS NOT NULL), 'string_agg', ','), '') AS names
    FROM (SELECT n_nationkey, CAST({ANSWERS} AS JSON) AS c FROM nation)""",
)
def k17(spark: SparkSession, d: str) -> DataFrame:
    content = F.expr(ANSWERS)
    return table(spark, d, "nation").select("n_nationkey", F.array_join(c.remote_models(content), ",").alias("names"))


@query("k19_run_json", "SELECT s_suppkey, '{\"name\":\"' || s_name || '\",\"s_nationkey\":' || s_nationkey || '}' AS j FROM supplier")
def k19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").withColumnRenamed("s_name", "name").select("s_suppkey", c.run_json("name", "s_nationkey").alias("j"))


@query("k20_model_lines", WITH + "SELECT model_id, rpad(model_id, CAST((SELECT max(length(model_id)) FROM models) AS INT), ' ') || '  ' || name AS line FROM models")
def k20(spark: SparkSession, d: str) -> DataFrame:
    return c.model_lines(models(spark, d))


@query("k24_digest_check", "SELECT s_suppkey, expected IS NULL OR sha256(s_name) = lower(expected) AS ok FROM (SELECT s_suppkey, s_name, CASE s_suppkey % 3 WHEN 0 THEN upper(sha256(s_name)) WHEN 1 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'bad' ELSE sha256(s_name) END END AS expected FROM supplier)")
def k24(spark: SparkSession, d: str) -> DataFrame:
    expected = F.expr("CASE s_suppkey % 3 WHEN 0 THEN upper(sha2(s_name, 256)) WHEN 1 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'bad' ELSE sha2(s_name, 256) END END")
    return table(spark, d, "supplier").select("s_suppkey", c.digest_ok(F.col("s_name").cast("binary"), expected).alias("ok"))


DOCUMENT = """CASE event_id % 6 WHEN 0 THEN '{"history_limit": ' || event_id || ', "shortcut_activation": "toggle", "selected_model": "m", "settings_schema_version": 2}'
 WHEN 1 THEN '{"history_limit": "bad", "shortcut_activation": "other", "word_correction_threshold": 1, "push_to_talk": true}' WHEN 2 THEN '{"translate_to_english": true, "transcribe_accelerator": "gpu", "overlay_position": "none"}'
 WHEN 3 THEN '[1]' WHEN 4 THEN 'no json' ELSE '{"transcribe_accelerator": "cpu", "transcribe_gpu_device": 3, "overlay_style": "none", "onboarding_completed": true, "push_to_talk": false, "whats_new_last_seen_version": "v1"}' END"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    return s.salvaged(table(spark, d, "events").select("event_id", F.expr(DOCUMENT).alias("content")))


@query("c1_salvage", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN event_id ELSE 5 END AS history_limit, CASE WHEN event_id % 6 = 0 THEN 'toggle' ELSE 'hold_or_toggle' END AS shortcut_activation, event_id % 6 = 2 AS translate_to_english, CASE WHEN event_id % 6 = 1 THEN 1.0 ELSE 0.18 END AS word_correction_threshold FROM events")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("event_id", "history_limit", "shortcut_activation", "translate_to_english", "word_correction_threshold")


#: Stored values of each sort: right, of another type, not allowed, missing, null.
STORED = [
    ('"paste_delay_ms": 90, "theme": "dark", "log_level": 2, "overlay_position": "none", "custom_words": ["a", "b"], "selected_channel": 1, "vad_enabled": false', (90, "dark", "debug", "bottom", "a,b", 1, False)),
    ('"paste_delay_ms": "sixty", "theme": 42, "log_level": 9, "overlay_position": "left", "custom_words": [1], "selected_channel": -1, "vad_enabled": "no"', (60, "system", "debug", "bottom", "", None, True)),
    ('"paste_delay_ms": -1, "theme": "Dark", "log_level": "WARN", "overlay_position": "top", "custom_words": [], "selected_channel": null, "vad_enabled": 0', (60, "system", "warn", "top", "", None, True)),
    ('"other": 1', (60, "system", "debug", "bottom", "", None, True)),
]
FIELD_NAMES = ("paste_delay_ms", "theme", "log_level", "overlay_position", "custom_words", "selected_channel", "vad_enabled")
STORED_JSON = "CASE event_id % 4 " + " ".join(f"WHEN {k} THEN '{{{text}}}'" for k, (text, _) in enumerate(STORED)) + " END"


def _literal(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


@query("c1_salvage_each_kind", "SELECT event_id, " + ", ".join(f"CASE event_id % 4 {' '.join(f'WHEN {k} THEN {_literal(want[n])}' for k, (_, want) in enumerate(STORED))} END AS {name}" for n, name in enumerate(FIELD_NAMES)) + " FROM events")
def c1k(spark: SparkSession, d: str) -> DataFrame:
    rows = s.salvaged(table(spark, d, "events").select("event_id", F.expr(STORED_JSON).alias("content")))
    return rows.select("event_id", *[F.array_join(n, ",").alias(n) if n == "custom_words" else n for n in FIELD_NAMES])


@query(
    "c2_migrations",
    """SELECT event_id, event_id % 6 IN (0, 5) AS onboarding_completed, CASE event_id % 6 WHEN 0 THEN 'toggle' WHEN 5 THEN 'toggle' ELSE 'hold_or_toggle' END AS shortcut_activation,
    'auto' AS transcribe_accelerator, CASE WHEN event_id % 6 IN (2, 5) THEN 'none' ELSE 'live' END AS overlay_style, CASE WHEN event_id % 6 = 5 THEN 'v1' ELSE '' END AS seen, 2 AS settings_schema_version FROM events""",
)
def c2(spark: SparkSession, d: str) -> DataFrame:
    return s.migrated(documents(spark, d)).select("event_id", "onboarding_completed", "shortcut_activation", "transcribe_accelerator", "overlay_style", F.col("whats_new_last_seen_version").alias("seen"), F.col("settings_schema_version").cast("int").alias("settings_schema_version"))


@query("c3_merged_defaults", "SELECT s_suppkey AS id, s_name AS name, s_suppkey % 2 = 0 AS supports_structured_output FROM supplier UNION ALL SELECT k, 'default', k % 2 = 0 FROM (SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier))")
def c3(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "true AS supports_structured_output")
    defaults = table(spark, d, "part").selectExpr("p_partkey AS id", "'default' AS name", "p_partkey % 2 = 0 AS supports_structured_output")
    return s.merged_defaults(stored, defaults)


@query("c4_prompt_lists", "SELECT n_nationkey, 'a,b2,c' AS added, 'a,new' AS updated, 'b2' AS deleted, 'b2' AS selected FROM nation")
def c4(spark: SparkSession, d: str) -> DataFrame:
    prompts = F.expr("array(named_struct('id', 'a', 'name', 'A', 'prompt', 'x'), named_struct('id', 'b', 'name', 'b2', 'prompt', 'y'))")
    ids = lambda x: F.array_join(F.transform(x, lambda p: F.when(p["id"] == "b", p["name"]).otherwise(p["id"])), ",")
    return table(spark, d, "nation").select("n_nationkey", ids(s.prompt_added(prompts, "c", "C", "z")).alias("added"), ids(s.prompt_updated(prompts, "b", "new", "z")).alias("updated"), ids(s.prompt_deleted(prompts, "a")).alias("deleted"), F.when(s.prompt_selection(prompts, F.lit("a"), "a") == "b", "b2").alias("selected"))


@query("c5_set_field", "SELECT event_id, CAST(250 AS BIGINT) AS hold_threshold_ms FROM events")
def c5(spark: SparkSession, d: str) -> DataFrame:
    return s.with_setting(documents(spark, d), "hold_threshold_ms", 250).select("event_id", "hold_threshold_ms")
