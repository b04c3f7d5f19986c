"""Errors and events of history changes, writers, header prefixes, salvage of single fields, and cleaning that can't fail."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from voxloom.functions import terms, text
from voxloom.operators import catalog, history, registry, settings
from voxloom.sources import media
from voxloom.sources.ledger import Ledger, StaleWriterError

ROWS = "id long, file_name string, timestamp long, saved boolean, title string, transcription_text string, post_processed_text string, post_process_prompt string, post_process_requested boolean"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(k, f"f{k}", 100 + k, k == 2, "t", f"text {k}", None, None, False) for k in (1, 2, 3)], ROWS)


def test_changes_of_missing_entries_are_errors(rows):
    for change in (lambda: history.updated(rows, 9, "x", None, None), lambda: history.toggled(rows, 9), lambda: history.toggled(rows.limit(0), 1)):
        with pytest.raises(LookupError, match="not found"):
            change()


def test_changes_tell_what_they_did(rows):
    after, event = history.updated(rows, 2, "new", "post", None)
    assert {r.id: r.transcription_text for r in after.collect()} == {1: "text 1", 2: "new", 3: "text 3"}
    assert [(r.action, r.id, r.transcription_text, r.post_processed_text, r.saved) for r in event.collect()] == [("updated", 2, "new", "post", True)]
    after, event = history.toggled(rows, 2)
    assert {r.id: r.saved for r in after.collect()} == {1: False, 2: False, 3: False} and [tuple(r) for r in event.collect()] == [("toggled", 2)]
    for ids in ([2, 9], rows.sparkSession.createDataFrame([(2,), (9,)], "id int")):
        after, event = history.deleted(rows, ids)
        assert sorted(r.id for r in after.collect()) == [1, 3]
        assert sorted(tuple(r) for r in event.collect()) == [("deleted", 2), ("deleted", 9)]


def test_appended_entries_get_ids(spark, rows, tmp_path):
    entries = rows.select("file_name", "transcription_text", "post_processed_text", "post_process_prompt", "post_process_requested")
    path = str(tmp_path / "history")
    assert sorted(r.id for r in Ledger(spark, path).append(entries, 1_704_441_600).collect()) == [1, 2, 3]
    assert [r.id for r in Ledger(spark, path).append(entries.filter("file_name = 'f1'"), 1_704_441_601).collect()] == [4]
    read = {r.id: r for r in Ledger(spark, path).rows().collect()}
    assert set(read) == {1, 2, 3, 4} and read[4].file_name == "f1" and not read[2].saved and read[1].title == "January  5, 2024 -  8:00AM"


def test_ids_are_never_given_again(spark, rows, tmp_path):
    entries = rows.select("file_name", "transcription_text", "post_processed_text", "post_process_prompt", "post_process_requested")
    path = str(tmp_path / "history")
    Ledger(spark, path).append(entries, 1_704_441_600)
    Ledger(spark, path).delete(spark.createDataFrame([(3,), (2,), (77,)], "id long"))
    assert [r.id for r in Ledger(spark, path).rows().collect()] == [1]
    assert sorted(r.id for r in Ledger(spark, path).append(entries, 1_704_441_601).collect()) == [4, 5, 6]
    Ledger(spark, path).compact()
    Ledger(spark, path).delete(spark.createDataFrame([(6,)], "id long"))
    assert [r.id for r in Ledger(spark, path).append(entries.limit(1), 1_704_441_602).collect()] == [7]
    assert sorted(r.id for r in Ledger(spark, path).rows().collect()) == [1, 4, 5, 7]
    assert sorted(r.id for r in Ledger(spark, path, 1).rows().collect()) == [1, 2, 3]  # as of a version


def test_a_batch_counts_once_and_a_stale_writer_is_refused(spark, rows, tmp_path):
    path = str(tmp_path / "history")
    write = Ledger(spark, path).sink("s")
    write(rows, 0)
    write(rows.withColumn("title", F.lit("new")), 1)
    version = Ledger(spark, path).version
    write(rows.withColumn("title", F.lit("again")), 1)  # replayed
    write(rows.withColumn("title", F.lit("old")), 0)
    assert Ledger(spark, path).version == version and {r.title for r in Ledger(spark, path).rows().collect()} == {"new"}
    one, two = Ledger(spark, path), Ledger(spark, path)
    one.upsert(rows.limit(1).withColumn("title", F.lit("first")))
    with pytest.raises(StaleWriterError):
        two.upsert(rows.withColumn("title", F.lit("late")))
    assert "late" not in {r.title for r in Ledger(spark, path).rows().collect()}
    assert Ledger(spark, path).rows().count() == 3


def header(pairs):
    name = lambda t: struct.pack("<Q", len(t)) + t.encode()
    return b"GGUF" + struct.pack("<IQQ", 3, 0, len(pairs)) + b"".join(name(k) + struct.pack("<I", 8) + name(v) for k, v in pairs)


def test_headers_are_read_by_prefix(spark, tmp_path):
    """A header beyond the first prefix is found, the tensors behind it are never read."""
    asked = []

    class Large:
        data = header([("x", "y" * 100_000), ("general.name", "A Model")])

        def __call__(self, size):
            asked.append(size)
            return (self.data + bytes(max(0, size - len(self.data))))[:size]

    assert media.growing_header(Large(), ("general.name",))["general.name"][1] == "A Model"
    assert asked[0] == 64 << 10 and max(asked) < 1 << 20
    (tmp_path / "a.gguf").write_bytes(Large.data + bytes(3 << 20))
    (tmp_path / "b c.gguf").write_bytes(b"GGUF")
    paths = [f"file:{tmp_path}/a.gguf", f"{tmp_path}/b c.gguf", f"{tmp_path}/none.gguf"]
    out = {r.path: r for r in media.probed(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert out[paths[0]].name == "A Model" and out[paths[0]].error is None
    assert out[paths[1]].error and out[paths[2]].error


def test_wav_files_are_written(spark, tmp_path):
    made = spark.createDataFrame([("a.wav", [0.0, 0.5, -1.5]), ("b.wav", []), (None, [0.1]), ("c.wav", None)], "file_name string, samples array<float>")
    for _ in range(2):
        out = {r.file_name: (r.bytes, r.samples) for r in media.write_wavs(made, f"file://{tmp_path}/wavs").collect()}
        assert out == {"a.wav": (50, 3), "b.wav": (44, 0)}
    read = {r.path.rsplit("/", 1)[1]: r for r in media.recordings(media.binary_files(spark, f"{tmp_path}/wavs", "*.wav")).collect()}
    assert set(read) == {"a.wav", "b.wav"} and [round(x, 3) for x in read["a.wav"].samples] == [0.0, 0.5, -1.0]


BINDING = {"id": "t", "name": "n", "description": "d", "default_binding": "f1", "current_binding": "f13"}


@pytest.mark.parametrize(
    ("stored", "want"),
    [
        ({"bindings": {"transcribe": BINDING}, "sound_theme": "theremin", "selected_model": "m"}, {"bindings": {"transcribe": BINDING}, "sound_theme": "marimba", "selected_model": "m"}),
        ({"bindings": {"transcribe": {"id": 42}}, "selected_model": "m"}, {"bindings": None, "selected_model": "m"}),
        ({"bindings": {"transcribe": BINDING | {"name": None}}}, {"bindings": None}),
        ({"paste_delay_ms": "sixty", "sound_theme": 42, "custom_words": ["w"]}, {"paste_delay_ms": 60, "sound_theme": "marimba", "custom_words": ["w"]}),
        ({"post_process_providers": [{"id": "a", "label": "b", "base_url": "c"}]}, {"post_process_providers": [{"id": "a", "label": "b", "base_url": "c"}]}),
        ({"post_process_providers": [{"id": "a", "label": "b", "base_url": "c", "allow_base_url_edit": 1}]}, {"post_process_providers": None}),
        ({"post_process_api_keys": {"a": "k"}, "post_process_models": {"a": 1}}, {"post_process_api_keys": {"a": "k"}, "post_process_models": {}}),
        ({"custom_filler_words": None, "log_level": 5, "overlay_style": "minimal", "overlay_position": "none"}, {"custom_filler_words": None, "log_level": "error", "overlay_style": "minimal", "overlay_position": "bottom"}),
        ({"unknown": 1, "audio_feedback_volume": 2, "vad_backend": "other", "reliable_paste": True}, {"audio_feedback_volume": 2.0, "vad_backend": "silero", "reliable_paste": True, "show_tray_icon": True}),
        ([1], {"selected_model": "", "history_limit": 5, "ort_accelerator": "auto"}),
    ],
)
def test_salvage(spark, stored, want):
    out = settings.salvaged(spark.createDataFrame([(json.dumps(stored),)], "content string"))
    row = out.select(*[F.to_json(n).alias(n) if n in ("bindings", "post_process_providers", "post_process_prompts") else n for n in want]).first()
    for name, value in want.items():
        got = row[name]
        assert (json.loads(got) if isinstance(value, (dict, list)) and isinstance(got, str) else got) == value, name


def test_every_field_has_a_default(spark):
    row = settings.salvaged(spark.createDataFrame([("{}",)], "content string")).first()
    names = [f.name for f in settings.FIELDS]
    assert len(names) == len(set(names)) == 62 and set(names) <= set(row.asDict())


def test_keys_of_any_depth(spark):
    deep = '{"a":' * 12 + "1" + "}" * 12
    docs = spark.createDataFrame([("en", deep), ("de", '{"b": {}, "c": []}')], "lang string, content string")
    assert sorted((r.lang, r.key_path) for r in catalog.flattened(docs).collect()) == [("de", "b"), ("de", "c"), ("en", ".".join("a" * 12))]


def test_a_text_that_cannot_be_corrected_stays(spark, monkeypatch):
    rows = spark.createDataFrame([("helo  wrold uh",)], "x string")
    assert rows.select(text.clean_transcript("x", F.lit("en"), terms=["hello", "world"], threshold=0.5).alias("y")).first().y == "hello world"
    real = terms.Dictionary

    def broken(names, threshold):
        made = real(names, threshold)
        made.keys = [(k, None) for k, _ in made.keys]  # a match has no term to put in
        return made

    monkeypatch.setattr(terms, "Dictionary", broken)
    rows = spark.createDataFrame([("helo  wrold",), ("other",)], "x string")
    assert [r.y for r in rows.select(text.correct_terms("x", ["hello"], 0.5).alias("y")).collect()] == ["helo  wrold", "other"]


def test_detected_language_counts_where_none_is_evident(spark):
    rows = spark.createDataFrame([("äh gut", None, "de"), ("äh gut", "en", "de"), ("äh gut", None, None)], "x string, lang string, found string")
    got = [r.y for r in rows.select(text.clean_transcript("x", F.col("lang"), detected=F.col("found")).alias("y")).collect()]
    assert got == ["gut", "äh gut", "äh gut"]


def test_places_of_a_registry(spark):
    rows = spark.createDataFrame([(f"m{k}", k % 3, k % 2 == 0, None if k % 5 == 0 else k % 4, k % 3, f"n{k % 7}") for k in range(80)], "model_id string, rank_of long, is_recommended boolean, accuracy int, speed int, name string")
    got = {r.model_id: r.place for r in registry.places(rows).collect()}
    want = [r.model_id for r in rows.orderBy(*registry.registry_order(), "model_id").collect()]
    assert [m for m, _ in sorted(got.items(), key=lambda x: x[1])] == want and sorted(got.values()) == list(range(1, 81))
