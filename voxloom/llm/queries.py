"""The contract queries of the training-data operators and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import decontaminate, divergence, fingerprint, jaccard, langid, lmscore, onebit, pieces, quality, resample, secrets, sharding, wrappers
from voxloom.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL), keep_ids=False)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.contiguous_shards(table(spark, sf_dir, "documents"), shards=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_language_id": op4_language_id,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_secret_scan": op6_secret_scan,
    "op7_sharding": op7_sharding,
    "op8_fingerprints": op8_fingerprints,
    "op9_quality": op9_quality,
    "op10_html_text": op10_html_text,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}
#: All pairs by shared shingle and components by closure: for tables of the size that the oracle is run on.
OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 4 THEN [array_to_string(a, ' ')]
    ELSE list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM r WHERE r.doc_id = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""

#: CRC by its table; the capacity by bisection, a row for each step of the greedy pass.
OP7_SQL = """
WITH RECURSIVE
crc_table AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce([k] || range(8), lambda a, i: xor(a // 2, (a % 2) * 3988292384)) AS v FROM range(256) AS r(k))),
base AS (SELECT doc_id, text, coalesce(strlen(text), 0) + 1 AS size FROM documents),
g AS (SELECT text, min(doc_id) AS head, sum(size)::BIGINT AS bytes FROM base GROUP BY text),
c AS (SELECT *, (sum(bytes) OVER (ORDER BY head))::BIGINT AS cum FROM g),
st(lo, hi, j, pos) AS (
  SELECT greatest(max(bytes), (max(cum) + 7) // 8)::BIGINT, max(cum)::BIGINT, 0, 0::BIGINT FROM c
  UNION ALL
  SELECT CASE WHEN j < 8 THEN lo WHEN pos < (SELECT max(cum) FROM c) THEN (lo + hi) // 2 + 1 ELSE lo END,
         CASE WHEN j < 8 THEN hi WHEN pos < (SELECT max(cum) FROM c) THEN hi ELSE (lo + hi) // 2 END,
         CASE WHEN j < 8 THEN j + 1 ELSE 0 END,
         CASE WHEN j < 8 THEN coalesce((SELECT max(cum) FROM c WHERE cum <= pos + (lo + hi) // 2), pos) ELSE 0 END
  FROM st WHERE lo < hi OR j > 0),
cap AS (SELECT lo AS capacity FROM st WHERE lo = hi AND j = 0 LIMIT 1),
ends(j, pos) AS (SELECT 0, 0::BIGINT UNION ALL SELECT j + 1, (SELECT max(cum) FROM c WHERE cum <= pos + (SELECT capacity FROM cap)) FROM ends WHERE j < 7),
sh AS (SELECT text, head, (SELECT count(*) FROM ends WHERE j > 0 AND pos <= cum - bytes) AS shard FROM c)
SELECT b.doc_id, b.size,
  xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, b.size - 1), lambda i: ('0x' || substr(hex(coalesce(b.text, '')), 2 * i + 1, 2))::BIGINT), lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1])), 4294967295) AS text_crc32,
  'bytes' AS law, sh.shard, row_number() OVER (PARTITION BY shard ORDER BY head, b.doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM base b JOIN sh ON b.text IS NOT DISTINCT FROM sh.text, crc_table
"""

#: Every kept term of every pair of sources, one by one.
OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(whole) AS total FROM kept GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n,
    (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (t.total + 2 * v.v))::HUGEINT AS p,
    (1 + 1000000000::HUGEINT * (kept.whole + 2) // (v.total + 2 * v.v))::HUGEINT AS q
  FROM t JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""

#: CRC by its table, once for each different word.
OP12_SQL = """
WITH crc_table AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce([k] || range(8), lambda a, i: xor(a // 2, (a % 2) * 3988292384)) AS v FROM range(256) AS r(k))),
texts AS (SELECT row_number() OVER () AS row, doc_id, text, false AS target FROM documents UNION ALL SELECT NULL, NULL, text, true FROM benchmark),
w AS (SELECT row, target, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM texts),
crc AS (
  SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT), lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM w), crc_table),
n AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM w JOIN crc USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain FROM n),
f AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM w JOIN crc USING (word) JOIN gain USING (bucket) WHERE NOT target GROUP BY row),
d AS (
  SELECT texts.row, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM texts LEFT JOIN f USING (row) WHERE NOT target),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (row)
"""

#: All inner products, in the order of components.
OP13_SQL = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce([0::DOUBLE] || list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES: dict[str, str] = {"op3_ngram_jaccard": OP3_SQL, "op7_sharding": OP7_SQL, "op11_divergence_audit": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_nearest_neighbours": OP13_SQL}
