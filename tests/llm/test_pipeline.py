"""The pipeline over a small copy of its tables, against a plain version of each decision."""

import random

import pytest
import sentencepiece

import corpus_pipeline
from voxloom.llm import secrets

SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices(["tha", "ing", "ou", "re", "st"], k=rng.randint(1, 4)))
    clean = lambda n: " ".join(word() for _ in range(n)) + "."
    item = clean(30)
    rows, labels = [], []
    for i in range(300):
        text = clean(rng.randint(30, 90))
        if i % 5 == 4:
            text = text.upper().replace(" ", "!! ")
        if i % 10 != 9:
            labels.append((i, int(i % 5 != 4), 0))
        rows.append([i, text])
    rows[10][1] = rows[2][1]
    rows[11][1] = rows[3][1] + " tail"
    rows[12][1] = f"{rows[12][1]} {item} more"
    rows[13][1] = f"{rows[13][1]} {SECRET} more"
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows] + [(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(rows)


def test_run(spark, tables):
    d, rows = tables
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    want = {i for i in rows if i % 5 != 4} - {10, 11, 12}
    assert set(out) - {None} == want
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.public_tokenizers.path(corpus_pipeline.PIECE_MODEL))
    for i in want - {13}:
        assert out[i].ids == library.encode(rows[i])
    assert library.decode(out[13].ids) == rows[13].replace(SECRET[:-1], secrets.MASK)


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables[0]).schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, docs.limit(0), tables[0]).count() == 0, name


def test_rows_without_id(spark, tables):
    """Groups with null ids keep one row, and contaminated rows without id go."""
    item = spark.read.parquet(f"{tables[0]}/benchmark.parquet").first().text
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(7, text(1)), (None, text(1)), (5, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (None, None), (None, None), (8, f"a {item} b"), (None, f"c {item} d")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    found = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=key)
    assert found(corpus_pipeline.deduplicated(spark, docs.limit(8), tables[0])) == sorted([(5, text(1)), (None, text(2)), (None, text(3)), (None, None), (None, None)], key=key)
    assert found(corpus_pipeline.decontaminated(spark, docs, tables[0])) == sorted(rows[:8], key=key)


def test_a_column_named_as_the_rows_own_stays(spark, tables):
    docs = spark.createDataFrame([(1, "some text of its own", "en", "s", 20, 5), (None, "another", "en", "s", 7, 6)], "doc_id long, text string, lang string, source string, n_chars long, _row int")
    for stage in (corpus_pipeline.deduplicated, corpus_pipeline.decontaminated):
        out = stage(spark, docs, tables[0])
        assert out.columns == docs.columns and sorted(r._row for r in out.collect()) == [5, 6]
