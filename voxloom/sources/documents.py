"""Text and JSON sources: catalogs (K6), settings (K16), locales (K22), release notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = (
    "id STRING, revision STRING, slug STRING, name STRING, architecture STRING, family STRING, parameters STRING, description STRING, languages ARRAY<STRING>, "
    "capabilities STRUCT<streaming: BOOLEAN, translate: BOOLEAN, lang_detect: BOOLEAN, timestamps: STRING>, speed_score INT, accuracy_score INT, "
    "files ARRAY<STRUCT<filename: STRING, quant: STRING, size_bytes: BIGINT, sha256: STRING>>, default_quant STRING, recommended BOOLEAN, recommended_rank INT"
)


def _fields(schema: str) -> str:
    """A column list as the fields of a struct."""
    out, depth = [], 0
    for part in schema.split(", "):
        if depth:
            out[-1] += f", {part}"
        else:
            out.append(part)
        depth += part.count("<") - part.count(">")
    return ", ".join(f"{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}" for c in out)


CATALOG = f"catalog_version INT, generated_at STRING, mirrors ARRAY<STRING>, models ARRAY<STRUCT<{_fields(MODEL)}>>"


def catalog_models(catalogs: DataFrame) -> DataFrame:
    """K6: a row for each model of catalogs (models, mirrors), in order; keys outside the schema are ignored."""
    return catalogs.select("mirrors", F.posexplode("models").alias("ord", "m")).select("ord", "mirrors", "m.*")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return catalog_models(spark.read.schema(CATALOG).option("multiLine", True).json(path))


def parsed_catalog(content) -> Column:
    return F.from_json(F.col(content) if isinstance(content, str) else content, CATALOG)


def _file(df: DataFrame, pattern: str, name: str) -> DataFrame:
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # a URI
    made = df.withColumn(name, F.regexp_extract(path, pattern, 1))
    return made.filter(F.col(name) != "")


def read_locales(spark: SparkSession, path: str) -> DataFrame:
    """(lang, content) of the files lang/translation.json under a folder."""
    return _file(spark.read.option("recursiveFileLookup", True).text(path, wholetext=True), r"([^/]+)/translation\.json$", "lang").select("lang", F.col("value").alias("content"))


def read_release_notes(spark: SparkSession, path: str) -> DataFrame:
    """(version, markdown) of the files version.md whose name is a version."""
    notes = _file(spark.read.text(path, wholetext=True), r"([^/]+)\.md$", "version")
    return notes.filter(F.col("version").rlike(r"^[vV]?\d+\.\d+\.\d+")).select("version", F.col("value").alias("markdown"))
