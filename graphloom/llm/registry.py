"""Queries that apply the operators, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Tables
from . import bpe_transducer, chat_format, decontaminate, html_extract, line_dedup, prefix_trie, quality_classifier
from . import quality_rules, sentencepiece_codec, simhash, source_divergence, token_files, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def piece_vocabulary() -> sentencepiece_codec.Vocabulary:
    return sentencepiece_codec.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = piece_vocabulary()
    encoded = sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), vocabulary, keep_text=True)
    decoded = sentencepiece_codec.decode(encoded, vocabulary)
    return decoded.select("doc_id", "n_tokens", "ids_crc32", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    return chat_format.read_chats(chat_format.format_chats(turns.unionByName(more)))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, _table(spark, sf_dir, "labels"))).drop("line_labels")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        token_files.write_tokens(_table(spark, sf_dir, "documents"), path, f.read())
    return token_files.read_tokens(spark, path)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, _table(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_lines(_table(spark, sf_dir, "documents"), counts=True)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe_transducer.digests(_table(spark, sf_dir, "documents"), f.read())


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_lists(_table(spark, sf_dir, "conversations")), tables))
    tables.keep()
    return found


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


#: A-Z is lower-cased by translate: lower() would change other letters too
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _term_hits(terms) -> str:
    """Sum over terms of their bounded occurrences; a mark is doubled so that neighbours share it."""
    return " + ".join(rf"len(regexp_extract_all(m, '[^\p{{L}}\p{{N}}]{t}[^\p{{L}}\p{{N}}]'))" for t in terms)


def _term_seen(terms, value) -> str:
    return " + ".join(rf"CASE WHEN regexp_matches(m, '[^\p{{L}}\p{{N}}]{t}[^\p{{L}}\p{{N}}]') THEN {value(t)} ELSE 0 END" for t in terms)


_STRICT = [t for t, w in url_filter.VOCABULARY.items() if w >= 1]
_SOFT = {t: w for t, w in url_filter.VOCABULARY.items() if w < 1}

OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
a AS (SELECT page_id, regexp_replace({_FOLD.format("url")}, '([^\\p{{L}}\\p{{N}}])', '\\1\\1', 'g') AS m0,
  CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM p),
b AS (SELECT page_id, ' ' || m0 || ' ' AS m, {_FOLD.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
c AS (SELECT *,
  CASE WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/7') THEN 'example.com/en/7'
       WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/de/8') THEN 'example.net/de/8'
       WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/en/') THEN 'com/en/'
       WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/de/') THEN 'net/de/'
       WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/es/') THEN 'org/es/' END AS rule,
  CAST({_term_hits(_STRICT)} AS BIGINT) AS n_strict, CAST({_term_hits(_SOFT)} AS BIGINT) AS n_soft,
  CAST({_term_seen(_SOFT, lambda t: 1)} AS BIGINT) AS n_distinct_soft,
  round(CAST({_term_seen(_SOFT, _SOFT.get)} AS DOUBLE), 6) AS weight FROM b)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN n_strict > 0 OR (n_distinct_soft >= {url_filter.DISTINCT_SOFT} AND weight >= {url_filter.SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END AS verdict,
  n_strict, n_soft, n_distinct_soft, weight FROM c"""

OP4_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) AS body,
  CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 11 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) END AS head FROM t),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt,
  CAST(sum(head + body + 8) AS BIGINT) AS formatted_chars,
  string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars,
  regexp_full_match(roles, 's?(ua)*u?') AND roles NOT IN ('') AS valid FROM g"""


#: CRC-32 of a decimal: each byte, then eight steps of the shift register, marked by -1
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
  lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""

OP12_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, substr(sha256(length(role) || ':' || role || text), 1, 32)) AS turns FROM t GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 5 AS head, CAST({_CRC} % 9 AS BIGINT) AS h FROM s),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN s b ON b.conv_id = h.head),
m AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS d, turns FROM r),
p AS (SELECT conv_id, n, d, turns[1:d] AS path FROM m),
g AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n), '') AS ends,
  CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(path[d].text) END AS saved FROM p GROUP BY path, d),
c AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
k AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c USING (path)),
u AS (SELECT path[1:e] AS path, saved, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM k)),
b AS (SELECT path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM u GROUP BY path)
SELECT k.conv_id, k.d AS depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN b USING (path) LEFT JOIN g q ON k.d > 0 AND q.path = k.path[1:k.d - 1]"""

OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all({_FOLD.format("text")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang),
gs AS (SELECT DISTINCT lang, source FROM docs),
n AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
gt AS (SELECT gs.*, coalesce(total, CAST(0 AS HUGEINT)) AS total FROM gs LEFT JOIN (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM n GROUP BY lang, source) USING (lang, source)),
p AS (SELECT gt.lang, gt.source, kept.term, coalesce(n.n, CAST(0 AS HUGEINT)) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n.n, CAST(0 AS HUGEINT)) + 1)) // (gt.total + v) AS p,
  1 + (CAST(1000000000 AS HUGEINT) * (kept.n + 1)) // (langs.total + v) AS q
  FROM gt JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN n ON n.lang = gt.lang AND n.source = gt.source AND n.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM gs a JOIN gs b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) FROM terms
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_url_filter": op2_url_filter,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_chat_format": op4_chat_format,
        "op5_html_extract": op5_html_extract,
        "op6_quality_rules": op6_quality_rules,
        "op7_simhash": op7_simhash,
        "op8_token_files": op8_token_files,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_line_dedup": op10_line_dedup,
        "op11_bpe": op11_bpe,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op4_chat_format": OP4_SQL, "op12_prefix_trie": OP12_SQL, "op13_source_divergence": OP13_SQL}
