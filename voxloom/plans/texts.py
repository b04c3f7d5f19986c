"""Queries of transcript cleaning and language codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import lang, text
from voxloom.operators import conversion, detection, dictionary
from voxloom.plans.base import registrar
from voxloom.sources.tables import HISTORY_SQL, history, table

QUERIES, ORACLES, query = registrar()
ALNUM = r"\p{L}\p{Nd}\p{Nl}\p{No}"
TOKENS = "tok AS (SELECT doc_id, w, i FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) AS i FROM documents) WHERE w <> '')"
TURNS = "SELECT conv_id, turn, "


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang")


@query("t1_match_key", f"SELECT doc_id, lower(regexp_replace(text, '[^{ALNUM}]', '', 'g')) AS key FROM documents")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.match_key("text").alias("key"))


@query(
    "t2_ngram_key",
    f"""SELECT conv_id, turn, i AS "at", lower(regexp_replace(array_to_string(a[i:i + 2], ''), '[^{ALNUM}]', '', 'g')) AS key
    FROM (SELECT conv_id, turn, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS a FROM conversations))""",
)
def t2(spark: SparkSession, d: str) -> DataFrame:
    """The key of three words from each word of a turn on."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.words("text").alias("a"))
    rows = rows.select("conv_id", "turn", "a", F.posexplode("a").alias("i", "w"))
    return rows.select("conv_id", "turn", (F.col("i") + 1).cast("long").alias("at"), text.ngram_key(F.expr("slice(a, i + 1, 3)")).alias("key"))


@query("t3_term_keys", "SELECT p_partkey, lower(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '', 'g')) AS first_key, regexp_full_match(p_name, '.*[A-Za-z0-9].*') AS has_key FROM part")
def t3(spark: SparkSession, d: str) -> DataFrame:
    keys = text.term_keys("p_name")
    return table(spark, d, "part").select("p_partkey", F.try_element_at(keys, F.lit(1)).alias("first_key"), (F.size(keys) > 0).alias("has_key"))


@query(
    "t4_supported_keys",
    f"SELECT doc_id, at_word, regexp_full_match(k, '[A-Za-z0-9]+') AS fuzzy, regexp_full_match(k, '[A-Za-z]+') AS soundex FROM (SELECT doc_id, i - 1 AS at_word, lower(regexp_replace(w, '[^{ALNUM}]', '', 'g')) AS k FROM (SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS a FROM documents)))",
)
def t4(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", F.posexplode(text.words("text")).alias("i", "w")).withColumn("k", text.match_key("w"))
    return rows.select("doc_id", F.col("i").cast("long").alias("at_word"), text.fuzzy_key_ok("k").alias("fuzzy"), text.soundex_ok("k").alias("soundex"))


NAMES = "(SELECT DISTINCT lower(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) AS k FROM nation)"


@query("t5_edit_distance_candidates", f"SELECT a.k AS candidate, b.k AS term, levenshtein(a.k, b.k) / CAST(greatest(length(a.k), length(b.k)) AS DOUBLE) AS share FROM {NAMES} a, {NAMES} b WHERE abs(length(a.k) - length(b.k)) <= greatest(greatest(length(a.k), length(b.k)) * 0.25, 2.0)")
def t5(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select(F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "")).alias("candidate")).distinct()
    pairs = names.join(F.broadcast(names.withColumnRenamed("candidate", "term")))  # 25 names
    longer = F.greatest(F.length("candidate"), F.length("term"))
    share = F.levenshtein("candidate", "term") / longer
    return pairs.filter(text.match_score("candidate", "term").isNotNull()).select("candidate", "term", share.alias("share"))


#: Soundex of a key of letters: digits of the letters, h and w aside, runs as one, the first letter in place of its own digit.
SOUNDEX = """soundex AS (SELECT k, upper(k[1]) || left(rpad(replace(array_to_string(list_filter(list_transform(range(2, len(c) + 1), lambda i: CASE WHEN c[i] <> c[i - 1] THEN c[i] ELSE '' END), lambda x: x <> ''), ''), '0', ''), 3, '0'), 3) AS code
  FROM (SELECT k, string_split(translate(k[1] || regexp_replace(k[2:], '[hw]', '', 'g'), 'bfpvcgjkqsxzdtlmnraeiouyhw', '11112222222233455600000000'), '') AS c FROM keys WHERE regexp_full_match(k, '[a-z]+')))"""


@query(
    "t5_match_scores",
    f"""WITH keys AS (SELECT DISTINCT lower(regexp_replace(n_name, '[^{ALNUM}]', '', 'g')) AS k FROM nation), {SOUNDEX}
    SELECT a.k AS candidate, b.k AS term, levenshtein(a.k, b.k) / CAST(greatest(length(a.k), length(b.k)) AS DOUBLE) * CASE WHEN sa.code = sb.code THEN CAST(0.3 AS DOUBLE) ELSE 1 END AS score
    FROM keys a JOIN keys b ON abs(length(a.k) - length(b.k)) <= greatest(greatest(length(a.k), length(b.k)) * 0.25, 2.0) LEFT JOIN soundex sa ON sa.k = a.k LEFT JOIN soundex sb ON sb.k = b.k""",
)
def t5s(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select(text.match_key("n_name").alias("candidate")).distinct()
    pairs = names.join(F.broadcast(names.withColumnRenamed("candidate", "term")))  # 25 names
    return pairs.select("candidate", "term", text.match_score("candidate", "term").alias("score")).filter("score IS NOT NULL")


TERMS = ("Thandle", "therein", "Erin", "the R&D", "ciudad")


#: Terms of the part table: names of several words, their words, types, and brands with letters alone.
PART_TERMS = "SELECT p_name AS term FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part UNION SELECT split_part(p_name, ' ', 2) FROM part UNION SELECT p_type FROM part UNION SELECT p_name || '&' || lower(p_type) FROM part"


def corrected_sql(source: str, table_of_terms: str | None = None) -> str:
    """Tables that end in `corrected` (doc_id, text): T6 of source (doc_id, text).

    The best match of the groups of one to three words at each place; then, among
    matches of several words, which ones stand when words are taken from left to right.
    """
    terms = ", ".join(f"({n}, '{key}', '{term}')" for n, (key, term) in enumerate((k, t) for t in TERMS for k in dict.fromkeys((_key(t), _key(t.replace("&", " and "))))))
    key = f"lower(regexp_replace(w, '[^{ALNUM}]', '', 'g'))"
    given = f"terms(nth, key, term) AS (VALUES {terms})"
    if table_of_terms:
        term_key = lambda x: f"lower(regexp_replace({x}, '[^{ALNUM}]', '', 'g'))"
        spelled = term_key("replace(term, '&', ' and ')")
        given = f"given AS (SELECT DISTINCT term FROM ({table_of_terms})), terms AS (SELECT DISTINCT term AS nth, key, term FROM (SELECT term, {term_key('term')} AS key FROM given UNION ALL SELECT term, {spelled} FROM given WHERE contains(term, '&')))"
    longest = 50 if table_of_terms else 12
    return f"""tk AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, {key} AS key, regexp_extract(w, '^[^{ALNUM}]*') AS prefix, regexp_extract(w, '[^{ALNUM}]*$') AS suffix
   FROM (SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS a FROM {source})) WHERE w <> ''),
 grp AS (SELECT doc_id, pos, 1 AS n, key AS k FROM tk
   UNION ALL SELECT a.doc_id, a.pos, 2, a.key || b.key FROM tk a JOIN tk b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.suffix = ''
   UNION ALL SELECT a.doc_id, a.pos, 3, a.key || b.key || c.key FROM tk a JOIN tk b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN tk c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 WHERE a.suffix = '' AND b.suffix = ''),
 {given},
 cand AS (SELECT DISTINCT k FROM grp WHERE length(k) <= {longest} AND regexp_full_match(k, '[A-Za-z0-9]+')),
 keys AS (SELECT k FROM cand UNION SELECT key FROM terms), {SOUNDEX},
 scored AS (SELECT c.k, t.nth, t.term, levenshtein(c.k, t.key) / CAST(greatest(length(c.k), length(t.key)) AS DOUBLE) * CASE WHEN sa.code = sb.code THEN CAST(0.3 AS DOUBLE) ELSE 1 END AS score
   FROM cand c JOIN terms t ON abs(length(c.k) - length(t.key)) <= greatest(greatest(length(c.k), length(t.key)) * 0.25, 2.0) LEFT JOIN soundex sa ON sa.k = c.k LEFT JOIN soundex sb ON sb.k = t.key),
 best AS (SELECT k, min(score) AS score, arg_min(term, (score, nth)) AS term FROM scored WHERE score < 0.18 GROUP BY k),
 hit AS (SELECT doc_id, pos, n, term FROM (SELECT g.doc_id, g.pos, g.n, b.term, row_number() OVER (PARTITION BY g.doc_id, g.pos ORDER BY b.score, g.n DESC) AS place FROM grp g JOIN best b ON b.k = g.k) WHERE place = 1),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM hit),
 taken(doc_id, r, pos, n, term, free, stands) AS (SELECT doc_id, r, pos, n, term, pos + n, true FROM ranked WHERE r = 1
   UNION ALL SELECT x.doc_id, x.r, x.pos, x.n, x.term, CASE WHEN x.pos >= t.free THEN x.pos + x.n ELSE t.free END, x.pos >= t.free FROM taken t JOIN ranked x ON x.doc_id = t.doc_id AND x.r = t.r + 1),
 stands AS (SELECT * FROM taken WHERE stands),
 covered AS (SELECT s.doc_id, s.pos + j.j AS pos FROM stands s, range(0, 3) AS j(j) WHERE j.j > 0 AND j.j < s.n),
 said AS (SELECT k.doc_id, k.pos, CASE WHEN s.term IS NULL THEN k.w ELSE k.prefix
    || CASE WHEN regexp_full_match(k.w, '\\p{{Lu}}+') THEN upper(s.term) WHEN regexp_matches(k.w, '^\\p{{Lu}}') THEN upper(s.term[1]) || s.term[2:] ELSE s.term END || z.suffix END AS w
   FROM tk k LEFT JOIN stands s ON s.doc_id = k.doc_id AND s.pos = k.pos LEFT JOIN tk z ON z.doc_id = k.doc_id AND z.pos = k.pos + s.n - 1
   WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = k.doc_id AND c.pos = k.pos)),
 corrected AS (SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text FROM {source} d LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS text FROM said GROUP BY doc_id) s USING (doc_id))"""


def _key(term: str) -> str:
    return "".join(c for c in term if c.isalnum()).lower()


@query("t6_custom_words", f"WITH RECURSIVE {corrected_sql('documents')} SELECT doc_id, text AS cleaned FROM corrected")
def t6(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.correct_terms("text", TERMS).alias("cleaned"))


TURN_TEXTS = "(SELECT conv_id || ':' || turn AS doc_id, text FROM conversations)"


@query("t6_terms_of_a_table", f"WITH RECURSIVE {corrected_sql(TURN_TEXTS, PART_TERMS)} SELECT doc_id, text AS cleaned FROM corrected")
def t6t(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").selectExpr("conv_id || ':' || turn AS doc_id", "text")
    return dictionary.corrected(turns, part_terms(spark, d)).select("doc_id", F.col("text").alias("cleaned"))


def part_terms(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(F.explode(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), "p_type", F.concat("p_name", F.lit("&"), F.lower("p_type")))).alias("term")).distinct()


@query(
    "t5_nearest_terms",
    f"""WITH words AS (SELECT DISTINCT lower(regexp_replace(w, '[^{ALNUM}]', '', 'g')) AS k FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents)),
    cand AS (SELECT k FROM words WHERE length(k) <= 50 AND regexp_full_match(k, '[A-Za-z0-9]+')),
    given AS (SELECT DISTINCT term FROM ({PART_TERMS})), terms AS (SELECT term, lower(regexp_replace(term, '[^{ALNUM}]', '', 'g')) AS key FROM given UNION SELECT term, lower(regexp_replace(replace(term, '&', ' and '), '[^{ALNUM}]', '', 'g')) FROM given WHERE contains(term, '&')),
    keys AS (SELECT k FROM cand UNION SELECT key FROM terms), {SOUNDEX},
    scored AS (SELECT c.k AS key, t.term, levenshtein(c.k, t.key) / CAST(greatest(length(c.k), length(t.key)) AS DOUBLE) * CASE WHEN sa.code = sb.code THEN CAST(0.3 AS DOUBLE) ELSE 1 END AS score
      FROM cand c JOIN terms t ON abs(length(c.k) - length(t.key)) <= greatest(greatest(length(c.k), length(t.key)) * 0.25, 2.0) LEFT JOIN soundex sa ON sa.k = c.k LEFT JOIN soundex sb ON sb.k = t.key),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, term) AS nth FROM scored WHERE score < 0.18)
    SELECT key, term, score FROM r WHERE nth = 1""",
)
def t5n(spark: SparkSession, d: str) -> DataFrame:
    words = docs(spark, d).select(F.explode(text.words("text")).alias("w")).select(text.match_key("w").alias("key")).distinct()
    return dictionary.nearest_terms(words, part_terms(spark, d))


@query(
    "t7_keep_case",
    """SELECT conv_id, turn, i - 1 AS "at", CASE WHEN regexp_full_match(w, '\\p{Lu}*') THEN upper('wOrd') WHEN regexp_matches(w, '^\\p{Lu}') THEN 'WOrd' ELSE 'wOrd' END AS word
    FROM (SELECT conv_id, turn, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS a FROM conversations))""",
)
def t7(spark: SparkSession, d: str) -> DataFrame:
    """The case of each word of a turn, given to another word."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(text.words("text")).alias("at", "w"))
    return rows.select("conv_id", "turn", F.col("at").cast("long").alias("at"), text.keep_case("w", F.lit("wOrd")).alias("word"))


@query("t8_edge_punctuation", f"SELECT doc_id, regexp_extract(text, '^[^{ALNUM}]*') AS prefix, regexp_extract(text, '[^{ALNUM}]*$') AS suffix FROM documents")
def t8(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.edge_punctuation("text").alias("e")).select("doc_id", "e.prefix", "e.suffix")


def fillers_sql(column: str, fillers) -> str:
    """T9's removal of fillers, one after the other; neighbours share the character between them, so each is looked for twice."""
    edge = "[^\\p{L}\\p{N}\\p{M}_]"
    for w in fillers:
        for _ in range(2):
            column = f"regexp_replace({column}, '(^|{edge})(?i:{w})(?:[,.]|({edge})|$)', '\\1\\2', 'g')"
    return column


def without_fillers_sql(source: str) -> str:
    """Tables that end in `bare` (doc_id, text): T9 of source (doc_id, text), by the documents' languages."""
    gated = " ".join(f"WHEN regexp_extract(lang, '^[^-_]*') = '{code}' THEN {fillers_sql('text', words)}" for code, words in text.GATED_FILLERS.items())
    return f"universal AS (SELECT doc_id, lang, {fillers_sql('s.text', text.UNIVERSAL_FILLERS)} AS text FROM {source} s JOIN (SELECT doc_id, lang FROM documents) l USING (doc_id)), bare AS (SELECT doc_id, CASE {gated} ELSE text END AS text FROM universal)"


@query("t9_drop_fillers", f"WITH plain AS (SELECT doc_id, text FROM documents), {without_fillers_sql('plain')} SELECT doc_id, text AS cleaned FROM bare")
def t9(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.drop_fillers("text", F.col("lang")).alias("cleaned"))


@query("t9_custom_fillers", f"SELECT doc_id, {fillers_sql('text', ['okay', 'right', 'the'])} AS cleaned FROM documents")
def t9c(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.drop_fillers("text", None, ["okay", "right", "the"]).alias("cleaned"))


STUTTERS = f"""WITH {TOKENS},
 a AS (SELECT *, lower(w) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM tok),
 b AS (SELECT *, CASE WHEN lag(l) OVER (PARTITION BY doc_id ORDER BY n) = l THEN 0 ELSE 1 END AS fresh FROM a),
 c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM b),
 e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY n) AS k, count(*) OVER (PARTITION BY doc_id, run) AS size FROM c),
 f AS (SELECT doc_id, string_agg(w, ' ' ORDER BY n) AS t FROM e WHERE NOT (size >= 3 AND k > 1 AND regexp_full_match(l, '\\p{{L}}+')) GROUP BY doc_id)
 SELECT d.doc_id, coalesce(f.t, d.text) AS cleaned FROM documents d LEFT JOIN f USING (doc_id)"""


@query("t10_collapse_stutters", STUTTERS)
def t10(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.collapse_stutters("text").alias("cleaned"))


@query("t11_normalize", STUTTERS.replace("coalesce(f.t, d.text)", "trim(regexp_replace(coalesce(f.t, d.text), '\\s{2,}', ' ', 'g'))"))
def t11(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.normalize("text").alias("cleaned"))


@query(
    "t12_clean_transcript",
    f"WITH RECURSIVE {corrected_sql('documents')}, {without_fillers_sql('corrected')}, "
    + STUTTERS.replace("WITH tok AS", "tok AS").replace("FROM documents", "FROM bare").replace("coalesce(f.t, d.text)", "trim(regexp_replace(coalesce(f.t, d.text), '\\s{2,}', ' ', 'g'))"),
)
def t12(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.clean_transcript("text", F.col("lang"), terms=TERMS).alias("cleaned"))


@query("t14_entry_title", f"WITH {HISTORY_SQL} SELECT id, title FROM history")
def t14(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).select("id", "title")


@query("t15_strip_invisible", "SELECT conv_id, turn, translate(text, chr(8203) || chr(8204) || chr(8205) || chr(65279), '') AS cleaned FROM (SELECT conv_id, turn, replace(text, ' ', ' ' || chr(8203)) || chr(65279) AS text FROM conversations)")
def t15(spark: SparkSession, d: str) -> DataFrame:
    odd = F.concat(F.replace(F.col("text"), F.lit(" "), F.lit(" ​")), F.lit("﻿"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.strip_invisible(odd).alias("cleaned"))


THINK = "CASE turn % 3 WHEN 0 THEN ' <think>' || role || chr(10) || '</think>  ' || text WHEN 1 THEN ' <think>' || text ELSE text || '<think>x</think>' END"


@query("t16_strip_think_block", TURNS + f"regexp_replace({THINK}, '^\\s*<think>.*?</think>\\s*', '', 's') AS cleaned FROM conversations")
def t16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.strip_think_block(F.expr(THINK)).alias("cleaned"))


@query("t17_system_prompt", TURNS + "trim(replace(' ' || role || ' ${output} ' || text || ' ${output} ', '${output}', ''), ' ' || chr(10) || chr(9)) AS prompt FROM conversations")
def t17(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit(" "), "role", F.lit(" ${output} "), "text", F.lit(" ${output} "))
    return table(spark, d, "conversations").select("conv_id", "turn", text.system_prompt(made).alias("prompt"))


@query("t18_blank", f"WITH {HISTORY_SQL} SELECT id, trim(transcription_text) = '' AS blank FROM history")
def t18(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).select("id", text.is_blank("transcription_text").alias("blank"))


ANSWER = """CASE turn % 4 WHEN 0 THEN '<think>t</think>{"transcription": "' || role || '"}' WHEN 1 THEN '{"transcription": 5}' WHEN 2 THEN '{"other": "x"}' ELSE 'not json ' || role END"""


@query(
    "t19_structured_transcript",
    TURNS + f"""CASE WHEN json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END, '$.transcription') = 'VARCHAR' THEN CAST(raw AS JSON)->>'$.transcription' ELSE raw END AS answer
    FROM (SELECT conv_id, turn, regexp_replace({ANSWER}, '^\\s*<think>.*?</think>\\s*', '', 's') AS raw FROM conversations)""",
)
def t19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.structured_transcript(F.expr(ANSWER)).alias("answer"))


#: Phrases of one and two letters made of the nations' names; at each place the longest is replaced.
PHRASES = "SELECT DISTINCT lower(substr(n_name, 1, k)) AS source, '<' || upper(substr(n_name, 1, k)) || '>' AS target FROM nation, (VALUES (1), (2)) AS u(k)"


@query(
    "t20_converted_text",
    f"""WITH p AS ({PHRASES}),
    c AS (SELECT conv_id, turn, text, i, (SELECT arg_max(target, length(source)) FROM p WHERE source IN (substr(text, i, 1), substr(text, i, 2))) AS target,
      coalesce((SELECT max(length(source)) FROM p WHERE source IN (substr(text, i, 1), substr(text, i, 2))), 1) AS n
      FROM (SELECT conv_id, turn, text, unnest(range(1, length(text) + 1)) AS i FROM conversations)),
    w AS (SELECT conv_id, turn, i, n, coalesce(target, substr(text, i, 1)) AS said, lag(n = 2) OVER (PARTITION BY conv_id, turn ORDER BY i) AS joined FROM c),
    b AS (SELECT *, sum(CASE WHEN coalesce(joined, false) THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM w),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, run ORDER BY i) AS nth FROM b)
    SELECT v.conv_id, v.turn, CASE WHEN v.text IS NULL THEN NULL ELSE coalesce((SELECT string_agg(said, '' ORDER BY i) FROM t WHERE t.conv_id = v.conv_id AND t.turn = v.turn AND nth % 2 = 1), '') END AS converted FROM conversations v""",
)
def t20c(spark: SparkSession, d: str) -> DataFrame:
    phrases = table(spark, d, "nation").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).selectExpr("lower(substr(n_name, 1, k)) AS source", "'<' || upper(substr(n_name, 1, k)) || '>' AS target")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return conversion.convert(rows, conversion.phrases_of(phrases)).select("conv_id", "turn", F.col("text").alias("converted"))


@query("t21_chosen_post_text", f"WITH {HISTORY_SQL} SELECT id, coalesce(post_processed_text, CASE WHEN upper(transcription_text) <> transcription_text THEN upper(transcription_text) END) AS chosen FROM history")
def t21(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).select("id", text.chosen_post_text("post_processed_text", F.upper("transcription_text"), "transcription_text").alias("chosen"))


@query("t22_trailing_space", TURNS + "text || ' ' AS t FROM conversations")
def t22(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.trailing_space("text").alias("t"))


@query("t23_redacted_url", "SELECT page_id, regexp_replace(regexp_replace(u, '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@', '\\1'), '[?#].*$', '') AS clean_url FROM (SELECT page_id, replace(url, '://', '://user:secret@') AS u FROM pages)")
def t23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.redacted_url(F.replace(F.col("url"), F.lit("://"), F.lit("://user:secret@"))).alias("clean_url"))


@query("t24_display_name", "SELECT s_suppkey, list_aggregate(list_transform(list_filter(string_split(replace(replace('my-bC_' || s_name, '-', ' '), '_', ' '), ' '), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS name FROM supplier")
def t24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", text.display_name(F.concat(F.lit("my-bC_"), "s_name")).alias("name"))


@query(
    "t25_model_size",
    """SELECT p_partkey, CASE WHEN mb <= 0 THEN 'Unknown size' WHEN mb >= 10240 THEN format('{:,.0f} GB', mb / 1024) WHEN mb >= 1024 THEN format('{:.1f} GB', mb / 1024) WHEN mb >= 100 THEN format('{:.0f} MB', mb) ELSE format('{:.1f} MB', mb) END AS size
    FROM (SELECT p_partkey, CAST(p_partkey * 8 - 8 AS DOUBLE) AS mb FROM part)""",
)
def t25(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.model_size(F.col("p_partkey") * 8 - 8).alias("size"))


@query(
    "t26_relative_time",
    f"""WITH {HISTORY_SQL}, a AS (SELECT id, (1706745600 - "timestamp") * 20 AS s FROM history)
    SELECT id, CASE WHEN s < 60 THEN s WHEN s < 3600 THEN s // 60 WHEN s < 86400 THEN s // 3600 WHEN s < 604800 THEN s // 86400 WHEN s < 2592000 THEN s // 604800 WHEN s < 31536000 THEN s // 2592000 ELSE s // 31536000 END AS n,
    CASE WHEN s < 60 THEN 'second' WHEN s < 3600 THEN 'minute' WHEN s < 86400 THEN 'hour' WHEN s < 604800 THEN 'day' WHEN s < 2592000 THEN 'week' WHEN s < 31536000 THEN 'month' ELSE 'year' END AS unit FROM a""",
)
def t26(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).select("id", text.relative_time((1_706_745_600 - F.col("timestamp")) * 20).alias("r")).select("id", "r.n", "r.unit")


@query("t27_version", "SELECT event_id, CAST(nullif(regexp_extract(v, '^v?(\\d+)\\.(\\d+)\\.(\\d+)', 1), '') AS BIGINT) AS major, CAST(nullif(regexp_extract(v, '^v?(\\d+)\\.(\\d+)\\.(\\d+)', 3), '') AS BIGINT) AS patch FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'beta' ELSE 'v' || event_id % 9 || '.0.' || event_id || '-rc' END AS v FROM events)")
def t27(spark: SparkSession, d: str) -> DataFrame:
    made = F.expr("CASE WHEN event_id % 5 = 0 THEN 'beta' ELSE concat('v', event_id % 9, '.0.', event_id, '-rc') END")
    v = text.version(made)
    return table(spark, d, "events").select("event_id", v["major"].alias("major"), v["patch"].alias("patch"))


CODES = "SELECT n_nationkey, ['en', 'EN_us', 'zh_Hant_HK', 'zh-Hans-TW', 'zh-TW', 'yue', 'yue-Hans', 'pt-BR', 'xx', 'de_AT', 'zh', 'fr-CA'][n_nationkey % 12 + 1] AS code FROM nation"


@query(
    "t28_ui_language",
    f"""WITH c AS (SELECT n_nationkey, lower(replace(code, '_', '-')) AS low FROM ({CODES})), known AS (SELECT unnest(['en', 'de', 'pt', 'zh', 'zh-TW']) AS k),
    w AS (SELECT *, regexp_extract(low, '^[^-_]*') AS base, list_contains(string_split(low, '-'), 'hans') AS hans, list_contains(string_split(low, '-'), 'hant') AS hant, list_has_any(string_split(low, '-'), ['tw', 'hk', 'mo']) AS place FROM c),
    x AS (SELECT *, CASE WHEN base = 'yue' THEN CASE WHEN hans THEN 'zh' ELSE 'zh-tw' END WHEN base = 'zh' AND (hant OR NOT hans AND place) THEN 'zh-tw' ELSE base END AS wanted FROM w)
    SELECT n_nationkey, coalesce(a.k, b.k) AS ui FROM x LEFT JOIN known a ON lower(a.k) = low LEFT JOIN known b ON lower(b.k) = wanted""",
)
def t28(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array(*map(F.lit, ["en", "EN_us", "zh_Hant_HK", "zh-Hans-TW", "zh-TW", "yue", "yue-Hans", "pt-BR", "xx", "de_AT", "zh", "fr-CA"]))
    return table(spark, d, "nation").select("n_nationkey", text.resolve_ui_language(F.element_at(codes, F.col("n_nationkey") % 12 + 1), ["en", "de", "pt", "zh", "zh-TW"]).alias("ui"))


# Language codes: each part with a wanted code and one of four lists of a model's codes.
INTENTS = ["auto", "en", "en-US", "de", "nb", "no", "zh-Hans", "zh-Hant", "fil", "tl", "pt_BR", "xx"]
LISTS = ["", "en", "de,en-GB,zh", "no,nb,tl,zh-Hans"]
INTENT_SQL = f"m AS (SELECT p_partkey, {INTENTS!r}[p_partkey % 12 + 1] AS intent, list_filter(string_split({LISTS!r}[p_partkey // 12 % 4 + 1], ','), lambda x: x <> '') AS s, p_partkey % 5 = 0 AS detect FROM part)"
BASE = "regexp_extract({}, '^[^-_]*')"
CANON = "CASE regexp_extract({0}, '^[^-_]*') WHEN 'nb' THEN 'no' WHEN 'fil' THEN 'tl' ELSE regexp_extract({0}, '^[^-_]*') END"


def wanted(spark: SparkSession, d: str) -> DataFrame:
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k.cast("int"))
    key = F.col("p_partkey")
    supported = F.filter(F.split(at(LISTS, F.expr("p_partkey div 12") % 4 + 1), ","), lambda x: x != "")
    return table(spark, d, "part").select("p_partkey", at(INTENTS, key % 12 + 1).alias("intent"), supported.alias("s"), (key % 5 == 0).alias("detect"))


EFFECTIVE = f"""SELECT p_partkey, CASE WHEN len(s) = 0 THEN intent WHEN intent <> 'auto' AND found IS NOT NULL THEN CASE WHEN intent IN ('zh-Hans', 'zh-Hant') THEN intent ELSE found END
 WHEN detect THEN 'auto' ELSE coalesce(list_filter(s, lambda x: {BASE.format("x")} = 'en')[1], CASE WHEN s[1] IN ('zh-Hans', 'zh-Hant') THEN 'zh' ELSE s[1] END) END AS effective
 FROM (SELECT *, coalesce(list_filter(s, lambda x: {BASE.format("x")} = {BASE.format("intent")})[1], list_filter(s, lambda x: ({CANON.format("x")}) = ({CANON.format("intent")}))[1]) AS found FROM m)"""


@query("m1_effective_language", f"WITH {INTENT_SQL} {EFFECTIVE}")
def m1(spark: SparkSession, d: str) -> DataFrame:
    return wanted(spark, d).select("p_partkey", lang.effective_language("intent", "s", "detect").alias("effective"))


@query("m2_base_and_canonical", f"WITH {INTENT_SQL} SELECT p_partkey, {BASE.format('intent')} AS base, {CANON.format('intent')} AS canon, regexp_extract(intent, '^[^-]*') AS by_hyphen FROM m")
def m2(spark: SparkSession, d: str) -> DataFrame:
    return wanted(spark, d).select("p_partkey", text.base_language("intent").alias("base"), lang.canonical("intent").alias("canon"), lang.base_by_hyphen("intent").alias("by_hyphen"))


@query("m3_canonical_list", f"WITH {INTENT_SQL} SELECT p_partkey, array_to_string(CASE WHEN len(s) = 4 THEN ['no', 'nb', 'tl', 'zh'] ELSE s END, ',') AS codes FROM m")
def m3(spark: SparkSession, d: str) -> DataFrame:
    return wanted(spark, d).select("p_partkey", F.array_join(lang.canonical_list(F.concat("s", "s")), ",").alias("codes"))


HINT = "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN '' ELSE intent END"
EVIDENCE = f"""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'translated' WHEN hint IS NOT NULL AND hint NOT IN ('', 'auto') THEN CASE WHEN ({CANON.format("hint")}) = 'no' THEN 'user_selected' ELSE 'model_constrained' END WHEN len(s) = 1 THEN 'model_constrained' ELSE 'unknown' END AS kind,
 CASE WHEN p_partkey % 11 = 0 THEN 'en' WHEN hint IS NOT NULL AND hint NOT IN ('', 'auto') THEN hint WHEN len(s) = 1 THEN s[1] END AS lang FROM (SELECT *, {HINT} AS hint FROM m)"""


@query("m4_language_evidence", f"WITH {INTENT_SQL} {EVIDENCE}")
def m4(spark: SparkSession, d: str) -> DataFrame:
    found = lang.evidence(F.lit("nb"), F.expr(HINT), "s", F.col("p_partkey") % 11 == 0)
    return wanted(spark, d).select("p_partkey", found.alias("e")).select("p_partkey", "e.kind", "e.lang")


@query("m5_detected_language", f"WITH {INTENT_SQL} SELECT p_partkey, CASE WHEN kind = 'unknown' AND p_partkey % 2 = 0 THEN 'model_detected' ELSE kind END AS kind, CASE WHEN kind = 'unknown' AND p_partkey % 2 = 0 THEN 'fr' ELSE lang END AS lang FROM ({EVIDENCE})")
def m5(spark: SparkSession, d: str) -> DataFrame:
    found = lang.evidence(F.lit("nb"), F.expr(HINT), "s", F.col("p_partkey") % 11 == 0)
    detected = F.when(F.col("p_partkey") % 2 == 0, "fr").otherwise("auto")
    return wanted(spark, d).select("p_partkey", lang.with_detected(found, detected).alias("e")).select("p_partkey", "e.kind", "e.lang")


PLAN = """SELECT p_partkey, CASE WHEN does THEN 'translate' ELSE 'transcribe' END AS task, l AS language, CASE WHEN does THEN 'en' END AS target
 FROM (SELECT *, detect AND p_partkey % 3 > 0 AND coalesce(l, '') <> 'en' AS does FROM (SELECT *, CASE WHEN intent <> 'auto' AND list_contains(s, CASE WHEN intent IN ('zh-Hans', 'zh-Hant') THEN 'zh' ELSE intent END) THEN CASE WHEN intent IN ('zh-Hans', 'zh-Hant') THEN 'zh' ELSE intent END END AS l FROM m))"""


@query("m6_run_plan", f"WITH {INTENT_SQL} {PLAN}")
def m6(spark: SparkSession, d: str) -> DataFrame:
    plan = lang.run_plan("detect", "intent", "s", F.col("p_partkey") % 3 > 0)
    return wanted(spark, d).select("p_partkey", plan.alias("p")).select("p_partkey", "p.task", "p.language", "p.target")


FOLD = "CASE WHEN {0} IN ('zh-Hans', 'zh-Hant') THEN 'zh' ELSE {0} END"


@query("m7_supports_language", f"WITH {INTENT_SQL} SELECT p_partkey, len(list_filter(s, lambda x: ({CANON.format('x')}) = ({CANON.format('intent')}))) > 0 AS supported FROM m")
def m7(spark: SparkSession, d: str) -> DataFrame:
    return wanted(spark, d).select("p_partkey", lang.supports("s", F.col("intent")).alias("supported"))


DETECTED = ["eng", "deu", "cmn", "mlt", "spa", "nld"]


@query(
    "t13_gated_detection",
    f"""WITH {INTENT_SQL}, t AS (SELECT *, ['en', 'de', 'zh', NULL, 'es', 'nl'][p_partkey % 6 + 1] AS two FROM m)
    SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 AND (p_partkey % 20) / 20.0 >= 0.9 AND (len(s) = 0 OR list_contains(list_transform(s, lambda x: regexp_extract(x, '^[^-_]*')), two)) THEN two END AS lang FROM t""",
)
def t13(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    found = F.element_at(F.array(*map(F.lit, DETECTED)), (key % 6 + 1).cast("int"))
    return wanted(spark, d).select("p_partkey", lang.gated_detection(found, key % 4 > 0, (key % 20) / 20.0, "s").alias("lang"))


@query("t13_detected_language")
def t13d(spark: SparkSession, d: str) -> DataFrame:
    """The language of each document by a model of all that are labelled, each row with the languages of a model of its own."""
    rows = docs(spark, d).selectExpr("doc_id", "text", "lang", "CASE doc_id % 4 WHEN 0 THEN array() WHEN 1 THEN array('en-GB', 'deu') WHEN 2 THEN array('fr', 'es', 'en', 'de', 'yue') ELSE array('yue') END AS codes")
    found = detection.detected(rows, detection.fitted(rows.select("text", F.col("lang").alias("language"))), codes="codes")
    return found.select("doc_id", "output_language", F.col("detected.language").alias("language"), F.col("detected.reliable").alias("reliable"))


@query("t20_script_conversion", f"WITH {INTENT_SQL} SELECT p_partkey, CASE intent WHEN 'zh-Hans' THEN 'to_simplified' WHEN 'zh-Hant' THEN 'to_traditional' END AS conversion FROM m")
def t20(spark: SparkSession, d: str) -> DataFrame:
    return wanted(spark, d).select("p_partkey", lang.script_conversion("intent").alias("conversion"))
