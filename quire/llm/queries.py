"""The registered queries of the text operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontam, langid, linededup, neardup, quality, secrets, sharding, toxicity, urls

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN)


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.layout(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.fitted(docs))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scanned(docs, secrets.fitted(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format")


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def _cuts(out: DataFrame) -> DataFrame:
    """What linededup.deduplicated removes and keeps, as digests."""
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    kept = F.coalesce("kept_text", F.lit(""))
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), words.alias("removed_words"), spans.alias("removed_spans"), F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(linededup.deduplicated(table(spark, sf_dir, "documents")))


def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(linededup.deduplicated(table(spark, sf_dir, "documents"), whole=True))


def toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules,
    "op2_byte_bpe": byte_bpe,
    "op3_decontamination": decontamination,
    "op4_jump_shards": jump_shards,
    "op5_language_id": language_id,
    "op6_near_duplicates": near_duplicates,
    "op7_secret_scan": secret_scan,
    "op8_url_filter": url_filter,
    "op9_line_dedup": line_dedup,
    "op10_toxicity": toxicity_score,
    "op9_passage_dedup": passage_dedup,  # beside op9_line_dedup, whose SQL fixes units; behind it, so that it does not stand in for it
}

_QUALITY_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), grams AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(ls) AS n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') AND strlen(x) > 1)) AS n_upper
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > greatest(1, n_words) OR 10 * n_upper > 3 * greatest(1, n_words)
            OR 2 * n_dup_lines > greatest(1, n_lines) OR word_chars < 2 * greatest(1, n_words) OR word_chars > 20 * greatest(1, n_words)) AS kept
FROM m
"""

_DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
), hits AS (SELECT doc_id, i, p.n, item FROM places p JOIN windows w ON w.n = p.n AND w.g = p.g),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


def _terms(terms: tuple[str, ...]) -> str:
    return ", ".join(f"'{t}'" for t in terms)


_URL_SQL = rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rules(verdict, rule, name, start) AS (
  SELECT v, r, split_part(r, '/', 1), substr(r, instr(r, '/')) FROM (VALUES {", ".join(f"('{v}', '{r}')" for v, r in urls.RULES)}) x(v, r)
), fit AS (
  SELECT page_id, rules.verdict, rule FROM h JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1
), t AS (
  SELECT page_id, list_sum(list_transform([{_terms(urls.STRICT_TERMS)}], lambda x: len(regexp_extract_all(' ' || regexp_replace(lower(url), '([^a-z0-9])', '\1\1', 'g') || ' ', '[^a-z0-9]' || x || '[^a-z0-9]')))) AS n_strict,
         len(list_filter([{_terms(urls.SOFT_TERMS)}], lambda x: regexp_matches(lower(url), '(^|[^a-z0-9])' || x || '([^a-z0-9]|$)'))) AS n_soft FROM u
)
SELECT h.page_id, host, path, rule, coalesce(fit.verdict, CASE WHEN n_strict > 0 OR n_soft >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n_strict AS BIGINT) AS n_strict, CAST(n_soft AS BIGINT) AS n_soft
FROM h LEFT JOIN fit ON fit.page_id = h.page_id JOIN t ON t.page_id = h.page_id
"""

_LINES_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, length(regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*')) AS lead,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS ws FROM documents
), w AS (
  SELECT doc_id, lead, k, ws[k] AS tok, regexp_extract(ws[k], '^[^\x20\x09-\x0D]+') AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM t)
), p AS (
  SELECT *, lead + sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY k) - length(tok) AS start,
         coalesce(sum(CASE WHEN regexp_matches(word, '[{linededup.MARKS}]$') OR contains(tok, chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM w
), u AS (
  SELECT doc_id, unit, count(*) AS words, min(start) AS start, max(start + length(tok)) AS stop,
         string_agg(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' ORDER BY k) AS norm FROM p GROUP BY doc_id, unit
), later AS (SELECT * FROM u QUALIFY min(doc_id) OVER (PARTITION BY norm) <> doc_id),
runs AS (
  SELECT doc_id, run, min(unit) AS first, max(unit) AS last, sum(words) AS words, min(start) AS start, max(stop) AS stop
  FROM (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM later) GROUP BY doc_id, run HAVING sum(words) >= {linededup.MIN_WORDS}
), spans AS (
  SELECT doc_id, count(*) AS n, sum(words) AS words, string_agg(CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start) AS spans FROM runs GROUP BY doc_id
), kept AS (
  SELECT p.doc_id, string_agg(tok, '' ORDER BY k) AS t FROM p LEFT JOIN runs ON runs.doc_id = p.doc_id AND p.unit BETWEEN first AND last WHERE runs.doc_id IS NULL GROUP BY p.doc_id
)
SELECT t.doc_id, CAST(coalesce(spans.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans.words, 0) AS BIGINT) AS removed_words, coalesce(spans, '') AS removed_spans,
       CAST(length(substr(t.t, 1, lead) || coalesce(kept.t, '')) AS BIGINT) AS kept_chars, sha256(substr(t.t, 1, lead) || coalesce(kept.t, '')) AS kept_sha256
FROM t LEFT JOIN spans ON spans.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id
"""

_PASSAGES_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, length(regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*')) AS lead,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS ws,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS norm FROM documents
), p AS (
  SELECT doc_id, k, tok, lead + sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY k) - length(tok) AS start FROM (SELECT doc_id, lead, unnest(ws) AS tok, unnest(range(1, len(ws) + 1)) AS k FROM t)
), windows AS (
  SELECT doc_id, k, md5(array_to_string(norm[k:k + {linededup.MIN_WORDS} - 1], ' ')) AS g FROM (SELECT doc_id, norm, unnest(range(1, len(norm) - {linededup.MIN_WORDS} + 2)) AS k FROM t)
), later AS (SELECT doc_id, k FROM windows QUALIFY min(doc_id) OVER (PARTITION BY g) <> doc_id),
gone AS (
  SELECT p.*, max(later.k) OVER (PARTITION BY p.doc_id ORDER BY p.k ROWS BETWEEN {linededup.MIN_WORDS} - 1 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM p LEFT JOIN later ON later.doc_id = p.doc_id AND later.k = p.k
), runs AS (
  SELECT doc_id, count(*) AS words, min(start) AS start, max(start + length(tok)) AS stop
  FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM gone WHERE gone) GROUP BY doc_id, run
), spans AS (
  SELECT doc_id, count(*) AS n, sum(words) AS words, string_agg(CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start) AS spans FROM runs GROUP BY doc_id
), kept AS (SELECT doc_id, string_agg(tok, '' ORDER BY k) AS t FROM gone WHERE NOT gone GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(spans.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans.words, 0) AS BIGINT) AS removed_words, coalesce(spans, '') AS removed_spans,
       CAST(length(substr(t.t, 1, lead) || coalesce(kept.t, '')) AS BIGINT) AS kept_chars, sha256(substr(t.t, 1, lead) || coalesce(kept.t, '')) AS kept_sha256
FROM t LEFT JOIN spans ON spans.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": _QUALITY_SQL,
    "op3_decontamination": _DECONTAMINATION_SQL,
    "op8_url_filter": _URL_SQL,
    "op9_line_dedup": _LINES_SQL,
    "op9_passage_dedup": _PASSAGES_SQL,
}
