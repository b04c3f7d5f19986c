"""The contract queries that SQL can express, against their oracles on the smallest tables, and all queries' columns."""

import os

import duckdb
import pytest

from voxloom.llm import queries

DATA = os.environ.get("VOXLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

COLUMNS = {
    "op1_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_html_text": "page_id bigint, url string, text string, n_chars bigint",
    "op11_divergence_audit": "lang string, source string, part string, item string, value bigint, rank int",
    "op12_importance_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: [str(x) for x in row]
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=key) == sorted(found.fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert set(COLUMNS[name].split(", ")) <= {f"{c} {t}" for c, t in df.dtypes}
    if name in ("op11_divergence_audit", "op13_nearest_neighbours"):
        return
    table = "pages" if name == "op10_html_text" else "documents"
    assert df.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
