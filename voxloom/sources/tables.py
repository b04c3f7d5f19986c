"""Adapters from the driver's tables to the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions.text import entry_title
from voxloom.session import on_workers

HISTORY_SCHEMA = (
    "id BIGINT, file_name STRING, timestamp BIGINT, saved BOOLEAN, title STRING, transcription_text STRING, post_processed_text STRING, post_process_prompt STRING, post_process_requested BOOLEAN"
)

#: The same adapter for DuckDB, as a common table expression named history.
HISTORY_SQL = """history AS (
  SELECT event_id AS id, 'rec-' || event_id || '.wav' AS file_name, CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp", event_type = 'purchase' AS saved,
         strftime(ts, '%B ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ', %Y - ') || lpad(CAST((hour(ts) + 11) % 12 + 1 AS VARCHAR), 2, ' ') || strftime(ts, ':%M%p') AS title,
         CASE WHEN event_type = 'error' THEN '' ELSE props END AS transcription_text,
         CASE WHEN event_type = 'signup' THEN event_type END AS post_processed_text,
         CAST(NULL AS VARCHAR) AS post_process_prompt, event_type = 'signup' AS post_process_requested
  FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcript history held by the events table."""
    stamp = F.unix_timestamp(F.col("ts").cast("timestamp"))
    kind: Column = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("rec-"), F.col("event_id").cast("string"), F.lit(".wav")).alias("file_name"),
        stamp.alias("timestamp"),
        (kind == "purchase").alias("saved"),
        entry_title(stamp).alias("title"),
        F.when(kind == "error", "").otherwise(F.col("props")).alias("transcription_text"),
        F.when(kind == "signup", kind).alias("post_processed_text"),
        F.lit(None).cast("string").alias("post_process_prompt"),
        (kind == "signup").alias("post_process_requested"),
    )


def frames(spark: SparkSession, sf_dir: str, threshold: float = 49.0) -> DataFrame:
    """Voice-activity frames: a session for each user, frames in order of time, voiced above the threshold."""
    order = Window.partitionBy("session").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", "event_id", "value")  # named first: later windows by session need no other shuffle
    return events.select("session", (F.row_number().over(order) - 1).cast("long").alias("i"), (F.col("value") > threshold).alias("voiced"))


FRAMES_SQL = "frames AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value > 49 AS voiced FROM events)"
