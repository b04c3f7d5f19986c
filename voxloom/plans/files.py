"""Queries of the sources and sinks that need files (K5, K11, K12, K18, K22, K23): small ones, written to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import catalog
from voxloom.plans.base import registrar
from voxloom.session import shared_dir
from voxloom.sources import documents, media
from voxloom.sources.ledger import Ledger
from voxloom.sources.tables import table

QUERIES, ORACLES, query = registrar()
NOW = 1_706_745_600


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/voxloom/{name}-{uuid.uuid4().hex}"


def stored(where: str, files: dict[str, str]) -> str:
    """Writes small text files by their names under a folder."""
    for name, text in files.items():
        system, base = media.opened(f"{where}/{name}")
        system.create_dir(base.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(base) as f:
            f.write(text.encode())
    return where


@query(
    "k5_append_history",
    f"""SELECT row_number() OVER (ORDER BY late, file_name) AS id, file_name, {NOW} + CAST(late AS INT) AS "timestamp", false AS saved, n_name AS transcription_text
    FROM (SELECT 'r-' || n_name AS file_name, n_name, n_nationkey % 2 = 1 AS late FROM nation)""",
)
def k5(spark: SparkSession, d: str) -> DataFrame:
    """Two appends, each of which gives ids above those of the one before."""
    path, none = folder(spark, "history"), F.lit(None).cast("string")
    for late in (0, 1):
        rows = table(spark, d, "nation").filter(F.col("n_nationkey") % 2 == late)
        entries = rows.select(F.concat(F.lit("r-"), "n_name").alias("file_name"), F.col("n_name").alias("transcription_text"), none.alias("post_processed_text"), none.alias("post_process_prompt"), F.lit(False).alias("post_process_requested"))
        Ledger(spark, path).append(entries, NOW + late)
    return Ledger(spark, path).rows().select("id", "file_name", "timestamp", "saved", "transcription_text")


@query(
    "d4_ids_are_given_once",
    """WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS id FROM events), n AS (SELECT count(*) AS n FROM events)
    SELECT id, 'rec-' || event_id AS file_name FROM e, n WHERE id <= n.n - 10 AND id % 4 > 0
    UNION ALL SELECT n.n + row_number() OVER (ORDER BY n_name), n_name FROM nation, n""",
)
def d4n(spark: SparkSession, d: str) -> DataFrame:
    """Entries are appended, the last ten and every fourth deleted, others appended: these have new ids."""
    path, none = folder(spark, "ledger"), F.lit(None).cast("string")
    rest = (none.alias("transcription_text"), none.alias("post_processed_text"), none.alias("post_process_prompt"), F.lit(False).alias("post_process_requested"))
    events = table(spark, d, "events").select(F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("file_name"), *rest)
    ids = Ledger(spark, path).append(events, NOW)
    Ledger(spark, path).delete(ids.filter((F.col("id") > events.count() - 10) | (F.col("id") % 4 == 0)))
    Ledger(spark, path).append(table(spark, d, "nation").select(F.col("n_name").alias("file_name"), *rest), NOW + 1)
    named = F.regexp_replace("file_name", "^e0*(?=[0-9])", "rec-")
    return Ledger(spark, path).rows().select("id", named.alias("file_name"))


@query(
    "k11_wav_files",
    """SELECT 'v' || vec_id || '.wav' AS file_name, i - 1 AS "at", round(least(32767, greatest(-32768, trunc(CAST(embedding[i] AS FLOAT) * CAST(32767 AS FLOAT)))) / 32767.0, 4) + 0.0 AS sample
    FROM embeddings, range(1, 100000) AS r(i) WHERE i <= len(embedding)""",
)
def k11(spark: SparkSession, d: str) -> DataFrame:
    """WAV files written and read again, sample by sample."""
    where = folder(spark, "wavs")
    media.write_wavs(table(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id", F.lit(".wav")).alias("file_name"), F.col("embedding").alias("samples")), where)
    read = media.recordings(media.binary_files(spark, where, "*.wav"))
    rows = read.select(F.regexp_extract("path", "[^/]+$", 0).alias("file_name"), F.posexplode("samples").alias("at", "sample"))
    return rows.select("file_name", F.col("at").cast("long").alias("at"), F.round(F.col("sample").cast("double"), 4).alias("sample"))


@query("k12_wav_verify", "SELECT vec_id FROM embeddings WHERE len(embedding) = len(embedding) - vec_id % 3")
def k12(spark: SparkSession, d: str) -> DataFrame:
    """Recordings that have as many samples as were written."""
    files = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), media.encoded_wav("embedding").alias("content"))
    read = media.recordings(files).select(F.col("path").cast("long").alias("vec_id"), "rate", "channels", "bits", F.size("samples").alias("samples"))
    wanted = table(spark, d, "embeddings").select("vec_id", (F.size("embedding") - F.col("vec_id") % 3).alias("expected"))
    return catalog.wav_ok(read.join(wanted, "vec_id")).select("vec_id")


STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 200 WHEN 1 THEN 206 WHEN 2 THEN 416 WHEN 3 THEN 404 ELSE 206 END"


@query(
    "k18_download_steps",
    f"""SELECT o_orderkey, CASE WHEN s = 206 AND p > 0 THEN 'append' WHEN s IN (200, 206) THEN 'restart' WHEN s = 416 AND p = t THEN 'finish' ELSE 'fail' END AS step
    FROM (SELECT o_orderkey, o_custkey % 4 AS p, o_orderkey % 3 AS t, {STATUS} AS s FROM orders)""",
)
def k18(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("p"), (F.col("o_orderkey") % 3).alias("t"), F.expr(STATUS).alias("s"))
    return rows.select("o_orderkey", media.download_step("p", "t", "s").alias("step"))


@query("k22_locale_files", "SELECT lower(r_name) AS lang, '{\"k\": \"' || r_name || '\"}' AS content FROM region")
def k22(spark: SparkSession, d: str) -> DataFrame:
    names = [r.r_name for r in table(spark, d, "region").select("r_name").collect()]  # five regions
    files = {f"{n.lower()}/translation.json": f'{{"k": "{n}"}}' for n in names}
    return documents.read_locales(spark, stored(folder(spark, "locales"), files | {"other/notes.txt": "x"}))


@query("k23_release_notes", "SELECT 'v1.' || r_regionkey || '.0' AS version, '# ' || r_name AS markdown FROM region WHERE r_regionkey > 0")
def k23(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "region").select("r_regionkey", "r_name").collect()  # five regions
    return documents.read_release_notes(spark, stored(folder(spark, "notes"), {f"v1.{r.r_regionkey}.0.md" if r.r_regionkey else "readme.md": f"# {r.r_name}" for r in rows}))
