"""Model registry: catalog records to models, ordering, discovery, filters.

A catalog row has `ord` (its place), id, revision, slug, name, description,
languages, capabilities, scores, `files` (filename, quant, size_bytes, sha256),
default_quant and recommendation. Small reference tables (catalog, mirrors,
listings) are joined, never looped over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.lang import supports
from voxloom.operators.ranking import placed

# Architectures that the runtime knows.
KNOWN_ARCHES = (
    "whisper", "parakeet", "qwen3_asr", "voxtral", "voxtral_realtime", "cohere", "cohere_asr", "canary", "canary_qwen", "moonshine", "moonshine_streaming",
    "sensevoice", "gigaam", "granite", "granite_speech", "granite_nar", "granite_speech_nar", "funasr_nano", "medasr", "moss", "sortformer",
)
UNRANKED = 4_294_967_295
STATUSES = ("extracting", "verifying", "downloading", "switching")


def default_file(files="files", quant="default_quant") -> Column:
    """The first file of the default quantisation, else the first."""
    f = F.col(files)
    return F.coalesce(F.try_element_at(F.filter(f, lambda x: x["quant"] == F.col(quant)), F.lit(1)), F.try_element_at(f, F.lit(1)))


def descriptors(catalog: DataFrame) -> DataFrame:
    """R2: one row for each file of each model, with its id and scores from 0 to 1."""
    default = default_file()
    rows = catalog.withColumn("_default", default["filename"]).select("*", F.posexplode("files").alias("file_ord", "file"))
    score = lambda c: (F.coalesce(F.col(c), F.lit(0)).cast("float") / F.lit(100.0).cast("float")).cast("float")
    return rows.select(
        F.concat_ws("/", "id", "file.filename").alias("model_id"), F.col("id").alias("repo_id"), "revision", "file.filename", "file.quant", "file.size_bytes", "file.sha256",
        "name", "description", "languages", score("accuracy_score").alias("accuracy"), score("speed_score").alias("speed"), F.coalesce("recommended", F.lit(False)).alias("recommended"),
        F.col("recommended_rank").alias("rank"), (F.col("file.filename") == F.col("_default")).alias("is_default"), "ord", "file_ord",
    )


def models(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Descriptors with their download status (model_id, is_downloaded, is_downloading); other quantisations carry theirs in the name and are not recommended."""
    joined = rows.join(status, "model_id", "left")
    return joined.select(
        "model_id", "repo_id", "filename", F.when(F.col("is_default"), F.col("name")).otherwise(F.format_string("%s (%s)", "name", "quant")).alias("name"), "description",
        F.expr("size_bytes div 1048576").alias("size_mb"), F.coalesce("is_downloaded", F.lit(False)).alias("is_downloaded"), F.coalesce("is_downloading", F.lit(False)).alias("is_downloading"),
        "accuracy", "speed", (F.col("recommended") & F.col("is_default")).alias("is_recommended"), "languages", "rank",
    )


def found_files(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """The first catalog file of each wanted filename (and repo_id, where that isn't null)."""
    files = catalog.select(F.col("id").alias("cat_repo"), "ord", F.posexplode("files").alias("file_ord", "file"))
    hit = wanted.join(files.hint("merge"), (wanted["filename"] == files["file"]["filename"]) & (wanted["repo_id"].isNull() | (wanted["repo_id"] == files["cat_repo"])))  # names made of few bytes look small enough to broadcast, and are not
    return hit.groupBy(wanted["filename"], wanted["repo_id"]).agg(F.min_by(F.struct("cat_repo", "file"), F.struct("ord", "file_ord")).alias("m")).select("filename", "repo_id", "m.cat_repo", "m.file")


def mirror_urls(rows: DataFrame, mirrors: DataFrame) -> DataFrame:
    """A URL for each mirror (base, mirror_ord) of each file with a revision and a digest. The mirrors are those of one catalog's list: one array for all files."""
    usable = rows.filter("revision IS NOT NULL AND sha256 IS NOT NULL")
    listed = mirrors.agg(F.collect_list(F.struct("mirror_ord", F.regexp_replace("base", "/+$", "").alias("base")))).scalar()
    each = usable.withColumn("m", F.explode(listed))
    return each.select("model_id", F.col("m.mirror_ord").alias("mirror_ord"), F.concat_ws("/", "m.base", "repo_id", "revision", "filename").alias("url"))


def ranked(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows (repo_id) with their catalog rank, the last possible one where there is none."""
    ranks = catalog.select(F.col("id").alias("repo_id"), F.col("recommended_rank").cast("long").alias("_rank")).dropDuplicates(["repo_id"])
    return rows.join(ranks, "repo_id", "left").withColumn("rank_of", F.coalesce("_rank", F.lit(UNRANKED))).drop("_rank")


def registry_order() -> list[Column]:
    """R7."""
    return [F.asc("rank_of"), F.desc("is_recommended"), F.desc("accuracy"), F.desc("speed"), F.asc("name")]


def places(rows: DataFrame, key: str = "model_id") -> DataFrame:
    """Rows with their place in the registry's order (ties by key)."""
    return placed(rows, [*registry_order(), F.asc(key)])


def merged(existing: DataFrame, found: DataFrame, key: str = "model_id") -> DataFrame:
    """Existing rows, and found ones whose key is new."""
    return existing.unionByName(unknown(found, existing, [key]), allowMissingColumns=True)


def unknown(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Found rows whose keys are not known."""
    return found.join(known.select(*keys).distinct(), keys, "left_anti")


def verdict(arch) -> Column:
    """R14."""
    a = F.col(arch) if isinstance(arch, str) else arch
    return F.when(a.isNull(), "unknown").when(a.isin(*KNOWN_ARCHES), "compatible").otherwise("incompatible")


def classified(found: DataFrame, catalog: DataFrame, probes: DataFrame) -> DataFrame:
    """Discovered files (filename, repo_id, place) with catalog metadata, else their probe (filename, arch, ...); files of the cache stay only if compatible, own files always."""
    known = catalog.select(F.inline("files"), F.col("name").alias("cat_name"), "ord").groupBy("filename").agg(F.min_by("cat_name", "ord").alias("cat_name"))
    joined = found.join(known, "filename", "left").join(probes.select("filename", "arch"), "filename", "left")
    out = joined.withColumn("origin", F.when(F.col("cat_name").isNotNull(), "catalog").otherwise("probe")).withColumn("verdict", F.when(F.col("cat_name").isNotNull(), "compatible").otherwise(verdict("arch")))
    return out.filter((F.col("place") != "cache") | (F.col("verdict") == "compatible")).withColumn("name", F.coalesce("cat_name", "filename"))


def refreshed(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows with is_downloaded by the listing (filename); own files and other quantisations that vanished go unless they are being downloaded."""
    there = listing.select("filename").distinct().withColumn("_there", F.lit(True))
    out = rows.drop("is_downloaded").join(there, "filename", "left").withColumn("is_downloaded", F.coalesce("_there", F.lit(False))).drop("_there")
    return out.filter(F.col("is_downloaded") | F.col("is_downloading") | ~(F.col("is_custom") | ~F.col("is_default")))


def with_runtime(rows: DataFrame, runtime: DataFrame) -> DataFrame:
    """Languages and flags as the loaded model (model_id, rt_languages, rt_translate) tells them; no languages leave the old ones."""
    j = rows.join(runtime, "model_id", "left")
    languages = F.when(F.coalesce(F.size("rt_languages"), F.lit(0)) > 0, F.col("rt_languages")).otherwise(F.col("languages"))
    return j.withColumn("languages", languages).withColumn("translate", F.coalesce("rt_translate", "translate")).drop("rt_languages", "rt_translate")


def selected(rows: DataFrame, current: str, onboarded: bool) -> DataFrame:
    """One row: the current model if it is on disk, else (after onboarding) the first downloaded one in registry order, else ''."""
    have = rows.filter("is_downloaded")
    keep = have.filter(F.col("model_id") == current).select("model_id", F.lit(0).alias("_p"), F.lit(0).cast("long").alias("_n")).limit(1)
    first = have.orderBy(*registry_order()).limit(1).select("model_id", F.lit(1).alias("_p"), F.lit(0).cast("long").alias("_n")) if onboarded else keep.limit(0)
    none = rows.sparkSession.range(1).select(F.lit("").alias("model_id"), F.lit(2).alias("_p"), F.col("id").alias("_n"))
    return keep.unionByName(first).unionByName(none).orderBy("_p").limit(1).select("model_id")


def local_capabilities(probes: DataFrame) -> DataFrame:
    """Unknown flags read as false; a language can be chosen if there are several."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return probes.select("filename", flag("translate"), flag("lang_detect"), flag("streaming"), (F.coalesce(F.size("languages"), F.lit(0)) > 1).alias("can_choose_language"))


def filtered(rows: DataFrame, *, language: str | None = None, streaming: bool = False, translation: bool = False, query: str = "") -> DataFrame:
    """What the model list shows: no legacy model that isn't there, and the filters that are set."""
    out = rows.filter(~F.col("is_legacy") | F.col("is_downloaded"))
    if language:
        out = out.filter(supports("languages", F.lit(language)))
    if streaming:
        out = out.filter("streaming")
    if translation:
        out = out.filter("translate")
    return out.filter(F.lower(F.concat_ws(" ", "name", "description")).contains(query.strip().lower())) if query.strip() else out


def sectioned(rows: DataFrame, current: str, order: str = "pos") -> DataFrame:
    """Downloaded rows (the active one first, own ones last), then available ones, else in their order."""
    return rows.withColumn("section", F.when(F.col("is_downloaded") | F.col("is_custom"), "downloaded").otherwise("available")).orderBy(F.desc("section"), F.desc(F.col("model_id") == current), F.asc("is_custom"), order)


def status(current: str) -> Column:
    """The first that holds of extracting, verifying, downloading, switching, downloadable, active, available."""
    out = F
    for s in STATUSES:
        out = out.when(F.col(f"is_{s}"), s)
    return out.when(~F.col("is_downloaded"), "downloadable").when(F.col("model_id") == current, "active").otherwise("available")


def with_default_device(devices: DataFrame) -> DataFrame:
    """The devices (name, pos) without default entries, and one default entry before them."""
    rest = devices.filter(F.lower("name") != "default")
    return rest.sparkSession.range(1).select(F.lit("Default").alias("name"), F.lit(-1).cast("long").alias("pos")).unionByName(rest.select("name", F.col("pos").cast("long").alias("pos")))


def distinct_count(a, b) -> Column:
    """How many different elements two arrays have."""
    return F.size(F.array_union(a, b))


def matching_languages(languages: DataFrame, query: str) -> DataFrame:
    """R21."""
    return languages.filter(F.lower("label").contains(query.lower()))


def ui_languages(languages: DataFrame) -> DataFrame:
    """The picker's languages with their place: by priority, then by name in the root collation."""
    return languages.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("priority"), F.collate("name", "UNICODE"))))  # one list of languages


def resolved_paths(rows: DataFrame) -> DataFrame:
    """Rows (model_id, kind, is_known, is_downloaded, is_downloading, cached_path, main_path, local_path, partial_path) with where the model lies, or why not."""
    hub = F.col("kind") == "hub"
    path = F.when(hub, F.coalesce("cached_path", "main_path", "local_path")).otherwise(F.when(F.col("partial_path").isNull(), F.col("local_path")))
    why = F.when(~F.col("is_known"), "unknown").when(~F.col("is_downloaded"), "not downloaded").when(F.col("is_downloading"), "downloading").when(path.isNull(), "missing")
    return rows.select("model_id", F.when(why.isNull(), path).alias("path"), why.alias("error"))


def after_delete(rows: DataFrame, model_id: str) -> DataFrame:
    """Without a deleted model: another quantisation goes alone, a default one with its whole repository."""
    gone = rows.filter(F.col("model_id") == model_id).select(F.when(F.col("is_default"), F.col("repo_id")).alias("_repo"), F.col("model_id").alias("_id"))
    return rows.join(F.broadcast(gone), (rows["model_id"] == gone["_id"]) | (rows["repo_id"] == gone["_repo"]), "left_anti")  # one row


def marked_unavailable(rows: DataFrame, model_id: str) -> DataFrame:
    """A model that can't be loaded: discovered ones go, others are no longer downloaded."""
    hit = F.col("model_id") == model_id
    return rows.filter(~(hit & F.col("is_discovered"))).withColumn("is_downloaded", F.col("is_downloaded") & ~hit)
