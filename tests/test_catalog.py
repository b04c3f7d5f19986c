"""Small cases of registry, catalog and settings operators; the queries themselves are held against SQL in test_queries."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxloom.operators import catalog, metrics, registry, settings
from voxloom.sources import documents, media


def test_files_without_digest_fail_the_run(spark):
    good = spark.createDataFrame([("r", "b.gguf", 2, "x"), ("r", "a-Q8_0.gguf", 1, "y"), ("r", "c.txt", None, None)], "repo string, filename string, size_bytes long, sha256 string")
    assert [[f.filename for f in r.files] for r in catalog.model_files(good).collect()] == [["a-Q8_0.gguf", "b.gguf"]]
    bad = spark.createDataFrame([("r", "b.gguf", 2, None)], "repo string, filename string, size_bytes long, sha256 string")
    with pytest.raises(PySparkException):
        catalog.model_files(bad).collect()


def test_half_even_scores(spark):
    df = spark.createDataFrame([(None,), (0.0,), (8.0,), (1000.0,)], "x double")
    assert [r.y for r in df.select(catalog.speed_score("x").alias("y")).collect()] == [10, 10, 63, 100]
    assert [r.y for r in df.select(catalog.accuracy_score("x").alias("y")).collect()] == [None, 100, 59, 0]


def test_unknown_flags_stay_unknown_until_shown(spark):
    probes = spark.createDataFrame([("f", None, True, None, ["en"])], "filename string, translate boolean, lang_detect boolean, streaming boolean, languages array<string>")
    r = registry.local_capabilities(probes).first()
    assert (r.translate, r.lang_detect, r.streaming, r.can_choose_language) == (False, True, False, False)
    df = spark.createDataFrame([(a,) for a in ("whisper", "other", None)], "arch string")
    assert [r.v for r in df.select(registry.verdict("arch").alias("v")).collect()] == ["compatible", "incompatible", "unknown"]


def test_prompts(spark):
    df = spark.createDataFrame([([("a", "A", "x")],)], "p array<struct<id:string,name:string,prompt:string>>")
    with pytest.raises(PySparkException):
        df.select(settings.prompt_deleted("p", "a")).collect()
    with pytest.raises(PySparkException):
        df.select(settings.prompt_updated("p", "zz", "n", "t")).collect()
    assert df.select(settings.prompt_updated("p", "a", "n", "t").alias("y")).first().y[0].name == "n"
    assert df.select(settings.prompt_selection("p", F.lit("a"), "a").alias("y")).first().y is None


def test_old_settings(spark):
    docs = spark.createDataFrame([('{"transcribe_gpu_device": 2, "transcribe_accelerator": "cpu", "selected_model": "m", "custom_words": ["a", 5], "hold_threshold_ms": "x"}',), (None,)], "content string")
    r = settings.migrated(settings.salvaged(docs)).collect()
    assert (r[0].transcribe_accelerator, r[0].transcribe_gpu_device, r[0].onboarding_completed, r[0].custom_words, r[0].hold_threshold_ms, r[0].settings_schema_version) == ("auto", None, True, [], 300, 2)
    assert (r[1].selected_model, r[1].history_limit) == ("", 5)


def test_receipts(spark):
    tx = spark.createDataFrame([(1, 0, 100, False, False, False), (2, 0, None, False, False, False), (3, 0, 100, True, False, False), (4, 0, 100, False, True, False)], "tx int, published_ms long, injected_ms long, injection_failed boolean, ownership_lost boolean, cancelled boolean")
    receipts = spark.createDataFrame([(1, 50), (1, 300), (2, 10)], "tx int, t_ms long")
    at = lambda now: [r.decision for r in metrics.receipt_decision(tx, receipts, now).orderBy("tx").collect()]
    assert at(400) == ["wait", "wait", "wait", "finish"]
    assert at(500) == ["finish", "wait", "finish", "finish"]
    assert at(8000) == ["finish"] * 4


def test_digests_and_downloads(spark):
    df = spark.createDataFrame([(b"abc", None), (b"abc", "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"), (b"abc", "00")], "c binary, e string")
    assert [r.y for r in df.select(catalog.digest_ok("c", "e").alias("y")).collect()] == [True, True, False]
    steps = spark.createDataFrame([(5, 9, 206), (5, 9, 200), (9, 9, 416), (5, 9, 416), (0, 9, 206), (0, 9, 500)], "p long, t long, s int")
    assert [r.y for r in steps.select(media.download_step("p", "t", "s").alias("y")).collect()] == ["append", "restart", "finish", "fail", "restart", "fail"]


def test_files_of_text_and_json(spark, tmp_path):
    for lang, body in (("en", '{"a": {"b": "x"}, "c": "y"}'), ("de", '{"a": {"b": "x", "z": ["q"]}}')):
        (tmp_path / "locales" / lang).mkdir(parents=True)
        (tmp_path / "locales" / lang / "translation.json").write_text(body)
    keys = catalog.flattened(documents.read_locales(spark, str(tmp_path / "locales")))
    assert sorted((r.lang, r.key_path, r.problem) for r in catalog.translation_audit(keys).collect()) == [("de", "a.z", "extra"), ("de", "c", "missing")]
    (tmp_path / "notes").mkdir()
    for name in ("1.2.3.md", "v2.0.0.md", "readme.md", "3.0.0.txt"):
        (tmp_path / "notes" / name).write_text(f"# {name}\nmore")
    from voxloom.operators.history import latest_release

    notes = documents.read_release_notes(spark, str(tmp_path / "notes"))
    assert sorted((r.version, r.markdown) for r in notes.collect()) == [("1.2.3", "# 1.2.3.md\nmore"), ("v2.0.0", "# v2.0.0.md\nmore")]
    assert [r.version for r in latest_release(notes, "1.9.0", "none").collect()] == ["1.2.3"]
    assert latest_release(notes, "beta", None).count() == 0
    (tmp_path / "c.json").write_text('{"catalog_version": 2,\n "mirrors": ["m"], "extra": 1, "models": [{"id": "a", "x": 2, "files": [{"filename": "f", "size_bytes": 7}]}, {"id": "b"}]}')
    assert [(r.ord, r.id, r.mirrors) for r in documents.read_catalog(spark, str(tmp_path / "c.json")).collect()] == [(0, "a", ["m"]), (1, "b", ["m"])]


@pytest.fixture
def listing(spark):
    rows = [(f"o/m{k}", f"f{k}.gguf", k, f"s{k}") for k in range(6)]
    return spark.createDataFrame(rows, "repo string, filename string, size_bytes long, sha256 string").withColumn("key", F.concat_ws("/", "repo", F.lit("new"), "filename"))


def test_a_plan_of_a_mirror_sends_no_listing_whole(spark, listing):
    objects = listing.filter("size_bytes = 1").select("key", "sha256").unionByName(listing.filter("size_bytes = 2").select("key", F.lit("bad").alias("sha256")))
    objects = objects.unionByName(listing.filter("size_bytes = 3").select(F.concat_ws("/", "repo", F.lit("old"), "filename").alias("key"), "sha256"))
    plan = catalog.mirror_plan(listing, objects)
    assert {r.size_bytes: r.action for r in plan.collect()} == {0: "upload", 1: "skip", 2: "mismatch", 3: "copy", 4: "upload", 5: "upload"}
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_breaches_without_a_join(spark):
    rows = [("a", 5, "x" * 64), ("a", 500, "a" * 64), ("b", 5, "a" * 64), ("c", 5, None), (None, 5, None)]
    found = spark.createDataFrame(rows, "id string, speed_score int, sha string").selectExpr("id", "speed_score", "1 AS accuracy_score", "array(named_struct('sha256', sha)) AS files", "'whisper' AS architecture")
    breaches = catalog.invariant_breaches(found)
    assert sorted(map(tuple, breaches.collect())) == [("a", "bad digest"), ("a", "duplicate id"), ("a", "score out of range"), ("c", "bad digest")]
    assert "Join" not in breaches._jdf.queryExecution().executedPlan().toString()


def test_catalog_files_are_found_without_a_broadcast(spark):
    file = "array<struct<filename:string,sha256:string>>"
    cat = spark.createDataFrame([(2, "o/b", [("f", "2"), ("g", "3")]), (1, "o/a", [("g", "0"), ("f", "1"), ("f", "9")])], f"ord int, id string, files {file}")
    wanted = spark.createDataFrame([("f", None), ("f", "o/b"), ("g", None), ("g", "o/c"), (None, None)], "filename string, repo_id string")
    found = registry.found_files(wanted, cat)
    assert sorted((r.filename, r.repo_id or "", r.cat_repo, r.file.sha256) for r in found.collect()) == [("f", "", "o/a", "1"), ("f", "o/b", "o/b", "2"), ("g", "", "o/a", "0")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
