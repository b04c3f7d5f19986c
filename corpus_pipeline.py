"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again before the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import decontaminate, jaccard, pieces, quality, secrets
from voxloom.llm.common import join_ids, table, written
from voxloom.session import on_workers

PIECE_MODEL = "piece_bpe_32k.model"
BROADCAST_IDS = 1_000_000
REMEMBER = 160_000  # segments; workers of the pipeline have other stages' memory to carry

#: The stages include classifiers, alignment and tokenization, which SQL can't express.
ORACLE_SQL = None


def _told_apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a further column, and its name (one that docs lacks): doc_id, or where that is null a number of the row's own, above the ids in use."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    unnamed = written(docs.filter("doc_id IS NULL").withColumn(row, F.lit(1 << 62) + F.monotonically_increasing_id()), "without-id")
    return docs.filter("doc_id IS NOT NULL").withColumn(row, F.col("doc_id").cast("long")).unionByName(unnamed), row


def _rows(docs: DataFrame, row: str) -> DataFrame:
    return docs.select(F.col(row).alias("doc_id"), "text")


def _without(docs: DataFrame, row: str, ids: DataFrame) -> DataFrame:
    """docs (told apart by row) but those whose row is in ids (doc_id), without row."""
    ids = written(ids.select(F.col("doc_id").alias(row)).distinct(), "dropped")
    return join_ids(docs, row, ids, "left_anti", BROADCAST_IDS).select(*[c for c in docs.columns if c != row])


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts."""
    on_workers(spark)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of near-duplicates, or one row of a group without any: five words, similarity of 0.8 or more."""
    on_workers(spark)
    docs, row = _told_apart(docs)
    found = jaccard.jaccard_components(_rows(docs, row), n=5, percent=80)
    return _without(docs, row, found.filter("component_id < doc_id").select("doc_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item."""
    docs, row = _told_apart(docs)
    found = decontaminate.contaminated(_rows(docs, row), table(spark, sf_dir, "benchmark"))
    return _without(docs, row, found.select("doc_id"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in all texts."""
    on_workers(spark)
    return secrets.masked(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and their digests."""
    on_workers(spark)
    return pieces.encode_documents(docs, public_tokenizers.path(PIECE_MODEL), remember=REMEMBER)


STAGES = [
    ("quality classifier", classified),
    ("n-gram Jaccard join", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("SentencePiece encoding", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
