import pytest

from voxloom.operators import history as h

SCHEMA = "id long, file_name string, timestamp long, saved boolean, title string, transcription_text string, post_processed_text string, post_process_prompt string, post_process_requested boolean"


def rows(spark, *entries):
    return spark.createDataFrame([(k + 1, f"f{k}", ts, saved, "t", text, post, None, False) for k, (ts, text, post, saved) in enumerate(entries)], SCHEMA)


def test_latest(spark):
    assert h.latest(rows(spark)).count() == 0
    both = rows(spark, (100, "first", None, False), (200, "second", "processed", False))
    assert [(r.timestamp, r.post_processed_text) for r in h.latest(both).collect()] == [(200, "processed")]
    assert [r.timestamp for r in h.latest(rows(spark, (100, "completed", None, False), (200, "", None, False))).collect()] == [100]


@pytest.mark.parametrize(("cursor", "limit", "ids", "more"), [(None, 2, [5, 4], True), (3, 2, [2, 1], False), (None, 0, [], True), (2, None, [5, 4, 3, 2, 1], False), (1, 2, [], False)])
def test_pages(spark, cursor, limit, ids, more):
    df = rows(spark, *[(k, "x", None, False) for k in range(5)])
    page, flag = h.page(df, cursor, limit)
    assert ([r.id for r in page.collect()], flag) == (ids, more)
    assert [(r.id, r.has_more) for r in h.page_with_flag(df, cursor, limit).collect()] == [(i, more) for i in ids]


def test_retention(spark):
    df = rows(spark, *[(k % 3, "x", None, k == 1) for k in range(8)])
    order = sorted(((k % 3, k + 1) for k in range(8) if k != 1), reverse=True)
    for keep in (0, 1, 3, 7, 20):
        assert sorted(r.id for r in h.beyond_newest(df, keep).collect()) == sorted(i for _, i in order[keep:])
    assert sorted(r.id for r in h.older_than(df, "days_3", 259_202).collect()) == sorted(k + 1 for k in range(8) if k % 3 < 2 and k != 1)
    assert h.expired(df, "never").count() == 0


def test_append_with_a_tiny_limit(spark):
    df = rows(spark, (10**12, "x", None, False))
    new = spark.createDataFrame([("g", "y", None, None, True)], "file_name string, transcription_text string, post_processed_text string, post_process_prompt string, post_process_requested boolean")
    kept, events = h.appended(df, new, 50, keep=1)
    assert [r.id for r in kept.collect()] == [1] and [(r.action, r.id) for r in events.collect()] == [("added", 2)]


def test_plans_push_down(spark, tmp_path):
    rows(spark, (1, "x", None, False)).write.parquet(str(tmp_path / "h"))
    plan = h.page_with_flag(spark.read.parquet(str(tmp_path / "h")), 5, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "LessThan(id,5)" in plan
