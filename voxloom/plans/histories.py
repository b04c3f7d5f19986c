"""Queries over the transcript history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import history as h
from voxloom.plans.base import registrar
from voxloom.sources.tables import HISTORY_SQL, history, table

QUERIES, ORACLES, query = registrar()
NOW = 1_706_659_200
ALL = 'id, file_name, "timestamp", saved, title, transcription_text, post_processed_text, post_process_prompt, post_process_requested'
WITH = f"WITH {HISTORY_SQL} "


@query("k1_history_scan", WITH + f"SELECT {ALL} FROM history")
def k1(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d)


@query("k2_migrate_schema", WITH + 'SELECT id, file_name, "timestamp", saved, title, transcription_text, CAST(NULL AS VARCHAR) AS post_processed_text, CAST(NULL AS VARCHAR) AS post_process_prompt, false AS post_process_requested FROM history')
def k2(spark: SparkSession, d: str) -> DataFrame:
    first = history(spark, d).drop("post_processed_text", "post_process_prompt", "post_process_requested")
    return h.migrated(first, 1)


@query("k3_newest_first", WITH + f"SELECT {ALL} FROM history ORDER BY id DESC")
def k3(spark: SparkSession, d: str) -> DataFrame:
    return h.newest_first(history(spark, d))


@query("k4_point_lookup", WITH + f"SELECT {ALL} FROM history WHERE id = 321")
def k4(spark: SparkSession, d: str) -> DataFrame:
    return h.by_id(history(spark, d), 321)


@query("p1_keyset_page", WITH + f"SELECT {ALL}, (SELECT count(*) FROM history WHERE id < 500) > 30 AS has_more FROM history WHERE id < 500 ORDER BY id DESC LIMIT 30")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return h.page_with_flag(history(spark, d), 500, 30)


@query("p1_first_page_clamped", WITH + f"SELECT {ALL}, (SELECT count(*) FROM history) > 100 AS has_more FROM history ORDER BY id DESC LIMIT 100")
def p1a(spark: SparkSession, d: str) -> DataFrame:
    return h.page_with_flag(history(spark, d), None, 500)


@query("p1_no_limit_ignores_cursor", WITH + f"SELECT {ALL}, false AS has_more FROM history")
def p1b(spark: SparkSession, d: str) -> DataFrame:
    return h.page_with_flag(history(spark, d), 500, None)


@query("p3_latest_completed", WITH + f"SELECT {ALL} FROM history WHERE transcription_text <> '' ORDER BY \"timestamp\" DESC, id DESC LIMIT 1")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return h.latest(history(spark, d))


@query("p3a_latest_any", WITH + f"SELECT {ALL} FROM history ORDER BY \"timestamp\" DESC, id DESC LIMIT 1")
def p3a(spark: SparkSession, d: str) -> DataFrame:
    return h.latest(history(spark, d), completed=False)


BEYOND = 'SELECT id FROM (SELECT id, row_number() OVER (ORDER BY "timestamp" DESC, id DESC) AS n FROM history WHERE NOT saved) WHERE n > 5'


@query("p4_retained_by_limit", WITH + f"SELECT {ALL} FROM history WHERE id NOT IN ({BEYOND})")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return h.retained(history(spark, d), "preserve_limit", keep=5)


@query("p4_retained_never", WITH + "SELECT id FROM history")
def p4n(spark: SparkSession, d: str) -> DataFrame:
    return h.retained(history(spark, d), "never").select("id")


@query("p5_beyond_newest", WITH + BEYOND)
def p5(spark: SparkSession, d: str) -> DataFrame:
    return h.beyond_newest(history(spark, d), 5).select("id")


for _period, _seconds in h.PERIODS.items():

    @query(f"p6_older_than_{_period}", WITH + f'SELECT id FROM history WHERE NOT saved AND "timestamp" < {NOW - _seconds}')
    def p6(spark: SparkSession, d: str, period: str = _period) -> DataFrame:
        return h.older_than(history(spark, d), period, NOW).select("id")


@query("p7_copy_text", WITH + "SELECT id, coalesce(post_processed_text, transcription_text) AS copy_text FROM history WHERE trim(coalesce(post_processed_text, transcription_text)) <> ''")
def p7(spark: SparkSession, d: str) -> DataFrame:
    return h.copy_text(history(spark, d))


@query("p8_top_picks", "SELECT p_partkey AS pos, CASE WHEN p_size <= 5 AND row_number() OVER (PARTITION BY p_size <= 5 ORDER BY p_partkey) <= 2 THEN 0 WHEN p_size <= 5 THEN 1 ELSE 2 END AS pick_group FROM part")
def p8(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_size") <= 5).alias("is_recommended"))
    return h.top_picks(parts).select("pos", "pick_group")


NOTES = "SELECT event_id AS id, 'v' || (event_id % 7) || '.' || (event_id % 11) || '.' || (event_id % 13) AS version FROM events"


@query("p9_latest_release", f"WITH n AS ({NOTES}), p AS (SELECT DISTINCT version, event_id % 7 AS a, event_id % 11 AS b, event_id % 13 AS c FROM (SELECT *, id AS event_id FROM n)) SELECT version FROM p WHERE a * 10000 + b * 100 + c <= 40506 AND a * 10000 + b * 100 + c > 10203 ORDER BY a DESC, b DESC, c DESC LIMIT 1")
def p9(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    notes = table(spark, d, "events").select(F.concat(F.lit("v"), (e % 7).cast("string"), F.lit("."), (e % 11).cast("string"), F.lit("."), (e % 13).cast("string")).alias("version"))
    return h.latest_release(notes, "4.5.6", "v1.2.3").select("version")


@query("p10_best_time", "SELECT user_id AS run, min(value) AS best_ms, CASE WHEN min(value) > 0 THEN max(value) / (min(value) / 1000.0) ELSE 0.0 END AS rtf FROM events GROUP BY user_id")
def p10(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("value").alias("ms"), F.col("value").alias("audio_secs"))
    return h.best_time(runs)


@query(
    "d1_append_and_retain",
    WITH + f""", new AS (SELECT (SELECT max(id) FROM history) + row_number() OVER (ORDER BY 'new-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0')) AS id, 'new-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS file_name, {NOW} AS "timestamp", false AS saved, n_name AS transcription_text FROM nation),
    every AS (SELECT id, file_name, "timestamp", saved, transcription_text FROM history UNION ALL SELECT * FROM new)
    SELECT id, file_name, "timestamp", saved, transcription_text FROM (SELECT *, row_number() OVER (PARTITION BY saved ORDER BY "timestamp" DESC, id DESC) AS n FROM every) WHERE saved OR n <= 40""",
)
def d1(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "nation").select(
        F.concat(F.lit("new-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("file_name"), F.col("n_name").alias("transcription_text"),
        F.lit(None).cast("string").alias("post_processed_text"), F.lit(None).cast("string").alias("post_process_prompt"), F.lit(False).alias("post_process_requested"),
    )
    kept, _ = h.appended(history(spark, d), entries, NOW, keep=40)
    return kept.select("id", "file_name", "timestamp", "saved", "transcription_text")


@query("d2_update_texts", WITH + "SELECT id, saved, CASE WHEN id = 77 THEN 'new' ELSE transcription_text END AS transcription_text, CASE WHEN id = 77 THEN NULL ELSE post_processed_text END AS post_processed_text, CASE WHEN id = 77 THEN 'p' ELSE post_process_prompt END AS post_process_prompt FROM history")
def d2(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = h.updated(history(spark, d), 77, "new", None, "p")
    return rows.select("id", "saved", "transcription_text", "post_processed_text", "post_process_prompt")


@query("d3_toggle_saved", WITH + "SELECT id, CASE WHEN id = 77 THEN NOT saved ELSE saved END AS saved FROM history")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return h.toggled(history(spark, d), 77)[0].select("id", "saved")


@query(
    "d2_d4_change_events",
    WITH + """SELECT 'updated' AS action, id, 'new' AS transcription_text FROM history WHERE id = 77 UNION ALL SELECT 'toggled', id, NULL FROM history WHERE id = 77
    UNION ALL SELECT 'deleted', k, NULL FROM (VALUES (5), (6), (999999999)) AS t(k)""",
)
def d2_events(spark: SparkSession, d: str) -> DataFrame:
    rows = history(spark, d)
    events = [h.updated(rows, 77, "new", None, "p")[1], h.toggled(rows, 77)[1], h.deleted(rows, [5, 6, 999999999])[1]]
    text = F.lit(None).cast("string").alias("transcription_text")
    return events[0].select("action", "id", "transcription_text").unionByName(events[1].select("action", "id", text)).unionByName(events[2].select("action", "id", text))


@query("d4_delete", WITH + "SELECT id FROM history WHERE id NOT IN (5, 6, 7, 999999999)")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return h.deleted(history(spark, d), [5, 6, 7, 999999999])[0].select("id")


@query("d5_bulk_delete_files", WITH + f"SELECT count(*) AS removed FROM history WHERE id IN ({BEYOND}) AND file_name IN (SELECT 'rec-' || o_orderkey || '.wav' FROM orders)")
def d5(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "orders").select(F.concat(F.lit("rec-"), F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("file_name"))
    return h.deleted_files(h.beyond_newest(history(spark, d), 5), files)


@query(
    "d6_merge_changes",
    """WITH c AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'view' THEN 'added' WHEN 'click' THEN 'updated' WHEN 'error' THEN 'deleted' ELSE 'toggled' END AS action, props AS entry FROM events)
    SELECT id, seq, action, entry FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM c WHERE action IN ('added', 'updated')) WHERE n = 1""",
)
def d6(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "view", "added").when(kind == "click", "updated").when(kind == "error", "deleted").otherwise("toggled")
    return h.merged_changes(table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), action.alias("action"), F.col("props").alias("entry")))
