"""Transcript history: pages, lookups, retention, changes.

All operators are DataFrame plans. Those that keep the newest rows take the
boundary by a top-k plan and filter against it, so nothing is ranked in one
task. Ties in time are broken by the greater id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.text import entry_title, is_blank, version
from voxloom.operators.ranking import placed

PAGE_MOST, PAGE_SIZE, KEEP = 100, 30, 5
# Seconds of the retention periods.
PERIODS = {"days_3": 259_200, "weeks_2": 1_209_600, "months_3": 7_776_000}

#: Columns by schema version, with their defaults, in order of the versions that added them.
VERSIONS = (
    ("file_name STRING", "timestamp BIGINT", "saved BOOLEAN", "title STRING", "transcription_text STRING"),
    ("post_processed_text STRING",),
    ("post_process_prompt STRING",),
    ("post_process_requested BOOLEAN",),
)


def migrated(df: DataFrame, version_from: int, version_to: int = len(VERSIONS)) -> DataFrame:
    """K2: df of an older schema version with the columns of the later ones (null, or false for flags)."""
    for added in VERSIONS[version_from:version_to]:
        for column in added:
            name, kind = column.split()
            if name not in df.columns:
                df = df.withColumn(name, F.lit(False if kind == "BOOLEAN" else None).cast(kind))
    return df


def lifted_version(user_version: int, migrations: DataFrame | None) -> DataFrame | int:
    """K2: the schema version to start from: the counter, or where that is 0 the last successful legacy migration (version, success)."""
    if user_version or migrations is None:
        return user_version
    return migrations.filter(F.col("success") == 1).agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def newest_first(df: DataFrame) -> DataFrame:
    """K3."""
    return df.orderBy(F.desc("id"))


def by_id(df: DataFrame, entry_id: int) -> DataFrame:
    """K4: a point lookup; the filter reaches the scan."""
    return df.filter(F.col("id") == entry_id)


def page(df: DataFrame, cursor: int | None = None, limit: int | None = PAGE_SIZE) -> tuple[DataFrame, bool]:
    """The entries of a page below cursor, newest first, and whether there are more. Without a limit: all, cursor ignored."""
    if limit is None:
        return newest_first(df), False
    limit = min(limit, PAGE_MOST)
    below = df if cursor is None else df.filter(F.col("id") < cursor)
    fetched = below.select("id").orderBy(F.desc("id")).limit(limit + 1).count()
    return newest_first(below).limit(limit), fetched > limit


def page_with_flag(df: DataFrame, cursor: int | None = None, limit: int | None = PAGE_SIZE) -> DataFrame:
    """P1 as one plan: each entry of the page with has_more. No action runs here; a page of no entries has no row for the flag."""
    if limit is None:
        return newest_first(df).withColumn("has_more", F.lit(False))
    limit = min(limit, PAGE_MOST)
    below = df if cursor is None else df.filter(F.col("id") < cursor)
    taken = newest_first(below).limit(limit + 1)  # a page and one row
    order = Window.orderBy(F.desc("id"))
    return taken.withColumn("_nth", F.row_number().over(order)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit).filter(F.col("_nth") <= limit).drop("_nth")


def latest(df: DataFrame, completed: bool = True) -> DataFrame:
    """The newest entry, with a text unless completed is false."""
    return (df.filter(F.col("transcription_text") != "") if completed else df).orderBy(F.desc("timestamp"), F.desc("id")).limit(1)


def _beyond(df: DataFrame, keep: int) -> Column:
    """Whether an entry is unsaved and older than the newest `keep` unsaved ones: a comparison with one value."""
    unsaved = F.coalesce(~F.col("saved"), F.lit(False))
    if keep <= 0:
        return unsaved
    newest = df.filter(unsaved).select("timestamp", "id").orderBy(F.desc("timestamp"), F.desc("id")).limit(keep)
    last = newest.agg(F.when(F.count("*") == keep, F.min(F.struct("timestamp", "id"))).alias("last")).scalar()
    return unsaved & F.coalesce(F.struct("timestamp", "id") < last, F.lit(False))


def beyond_newest(df: DataFrame, keep: int = KEEP) -> DataFrame:
    """P5: unsaved entries that are older than the newest `keep` unsaved ones."""
    return df.filter(_beyond(df, keep))


def older_than(df: DataFrame, period: str, now: int) -> DataFrame:
    """Unsaved entries from before the period."""
    return df.filter(~F.col("saved") & (F.col("timestamp") < now - PERIODS[period]))


def expired(df: DataFrame, policy: str, *, keep: int = KEEP, now: int = 0) -> DataFrame:
    """The entries that a retention policy (never, preserve_limit, or a period) removes."""
    if policy == "never":
        return df.limit(0)
    return beyond_newest(df, keep) if policy == "preserve_limit" else older_than(df, policy, now)


def retained(df: DataFrame, policy: str, *, keep: int = KEEP, now: int = 0) -> DataFrame:
    """The entries that stay."""
    if policy == "never":
        return df
    if policy == "preserve_limit":
        return df.filter(~_beyond(df, keep))
    return df.filter(F.col("saved") | (F.col("timestamp") >= now - PERIODS[policy]))


def appended(df: DataFrame, entries: DataFrame, now: int, *, policy: str = "preserve_limit", keep: int = KEEP, given: int = 0) -> tuple[DataFrame, DataFrame]:
    """Df with new entries (file_name, texts, post_process_requested), after retention, and the Added events of all of them.

    Ids follow the greatest there is or the greatest ever given (given; sources.ledger keeps it), in order of file_name.
    """
    top = F.greatest(df.agg(F.coalesce(F.max("id"), F.lit(0))).scalar(), F.lit(given))
    made = placed(entries, [F.asc("file_name")], "id").withColumns({"id": F.col("id") + top, "timestamp": F.lit(now).cast("long"), "saved": F.lit(False), "title": entry_title(F.lit(now))}).select(*df.columns)
    events = made.select(F.lit("added").alias("action"), "id")
    return retained(df.unionByName(made), policy, keep=keep, now=now), events


def _found(df: DataFrame, entry_id: int) -> DataFrame:
    """The entry of an id; an error if there is none."""
    entry = df.filter(F.col("id") == entry_id)
    if entry.select("id").isEmpty():
        raise LookupError(f"history entry {entry_id} not found")
    return entry


def updated(df: DataFrame, entry_id: int, text: str, post_text: str | None, prompt: str | None) -> tuple[DataFrame, DataFrame]:
    """Df with new texts for an id, other columns as they are, and the updated event with the new entry. A missing id is an error."""
    new = {"transcription_text": text, "post_processed_text": post_text, "post_process_prompt": prompt}

    def changed(rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: F.when(F.col("id") == entry_id, F.lit(v).cast("string")).otherwise(F.col(c)) for c, v in new.items()})

    event = changed(_found(df, entry_id)).select(F.lit("updated").alias("action"), *df.columns)
    return changed(df), event


def toggled(df: DataFrame, entry_id: int) -> tuple[DataFrame, DataFrame]:
    """D3: df with the saved mark of an id turned, and the toggled event. A missing id is an error."""
    event = _found(df, entry_id).select(F.lit("toggled").alias("action"), "id")
    return df.withColumn("saved", F.when(F.col("id") == entry_id, ~F.col("saved")).otherwise(F.col("saved"))), event


def deleted(df: DataFrame, ids: Sequence[int] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Df without some ids, and a deleted event for each of these; ids that aren't there don't matter, and have an event too."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col("id").cast("long").alias("id")).distinct()
        rest = df.join(wanted, "id", "left_anti")
    else:
        wanted = df.sparkSession.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "id long")
        rest = df.filter(~F.col("id").isin(list(ids)))
    return rest, wanted.select(F.lit("deleted").alias("action"), "id")


def deleted_files(doomed: DataFrame, files: DataFrame) -> DataFrame:
    """How many files (file_name) go with doomed entries; entries without a file are no part of the count."""
    return doomed.join(files.select("file_name").distinct(), "file_name", "left_semi").agg(F.count("*").alias("removed"))


def merged_changes(changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The newest added or updated state of each key; other actions are no part of it."""
    fields = [c for c in changes.columns if c != key]
    kept = changes.filter(F.col("action").isin("added", "updated"))
    return kept.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("s")).select(key, "s.*")


def copy_text(df: DataFrame) -> DataFrame:
    """The text to copy of each entry; an empty processed text counts, blank results don't."""
    text: Column = F.coalesce("post_processed_text", "transcription_text")
    return df.select("id", text.alias("copy_text")).filter(~is_blank(F.col("copy_text")))


def top_picks(df: DataFrame, picks: int = 2, flag: str = "is_recommended", order: str = "pos") -> DataFrame:
    """The first recommended rows, then the other recommended ones, then the rest, each in their order."""
    first = df.filter(F.col(flag)).orderBy(order).limit(picks).agg(F.max(order).alias("_last"))
    group = F.when(F.col(flag) & (F.col(order) <= F.col("_last")), 0).when(F.col(flag), 1).otherwise(2)
    return df.crossJoin(F.broadcast(first)).withColumn("pick_group", group).drop("_last").orderBy("pick_group", order)  # one row


def latest_release(notes: DataFrame, current: str, last_seen: str | None) -> DataFrame:
    """The newest release note up to the current version and, where the last seen version can be read, after it."""
    at = version("version")
    wanted = notes.withColumn("_v", at).filter(F.col("_v").isNotNull() & (F.col("_v") <= version(F.lit(current))))
    seen = version(F.lit(last_seen).cast("string"))
    return wanted.filter(seen.isNull() | (F.col("_v") > seen)).orderBy(F.desc("_v")).limit(1).drop("_v")


def best_time(runs: DataFrame, key: str = "run") -> DataFrame:
    """P10: the least time of each run's tries and its real-time factor, 0 where the time is 0."""
    best = F.min("ms")
    return runs.groupBy(key).agg(best.alias("best_ms"), F.when(best > 0, F.max("audio_secs") / (best / 1000.0)).otherwise(F.lit(0.0)).alias("rtf"))
