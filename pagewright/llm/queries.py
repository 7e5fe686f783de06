"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import (
    byte_bpe, decontam, filter_audit, hard_negatives, html_blocks, lang_gru, line_rules, near_dup, pseudo_lm, quotes, sharding, site_quality, toxic_crf,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(_table(spark, sf_dir, "conversations"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_blocks.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_gru.identify(_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), with_ids=False)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    judged = line_rules.apply_line_rules(docs, **line_rules.LIMITS, clean_col=None)
    return judged.drop("text", "source")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_crf.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = [op1_quotation_links, op2_main_text, op3_language, op4_near_duplicates, op5_byte_bpe, op6_decontamination, op7_pseudo_likelihood, op8_site_quality, op9_line_rules, op10_toxicity, op11_filter_audit, op12_hard_negatives, op13_sharding]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"


def _shingled(table: str, key: str) -> str:
    """SQL for distinct (key, shingle) of a table."""
    return f"""
      SELECT DISTINCT {key}, s FROM (
        SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
        FROM (SELECT {key}, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM {table} WHERE text IS NOT NULL))"""


OP4_SQL = f"""
WITH RECURSIVE sh AS MATERIALIZED ({_shingled("documents", "doc_id")}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id),
least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.r, d.doc_id) AS component_id, coalesce(least.r, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""

OP6_SQL = f"""
WITH d AS ({_shingled("documents", "doc_id")}), b AS ({_shingled("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n_item"""

OP9_SQL = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '{_WORD}') AS w FROM docs),
lines AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
norm AS (SELECT r, host, text, line, i, regexp_extract_all({_LOWER.replace("text", "line")}, '{_WORD}') AS w FROM lines WHERE regexp_matches(line, '{_WORD}')),
suspect AS MATERIALIZED (
  SELECT host, k FROM (SELECT host, array_to_string(w, ' ') AS k, count(DISTINCT text) AS n FROM norm GROUP BY ALL) WHERE n >= 8
  UNION SELECT h.host, k FROM (SELECT array_to_string(w, ' ') AS k, count(DISTINCT text) AS n FROM norm GROUP BY ALL), (SELECT DISTINCT host FROM docs) h WHERE n >= 8),
covered AS MATERIALIZED (
  SELECT text, row_number() OVER () AS t FROM (
    SELECT DISTINCT norm.text FROM norm JOIN words USING (r) JOIN suspect ON norm.host = suspect.host AND array_to_string(norm.w, ' ') = k
    GROUP BY r, norm.text, words.w HAVING 4 * sum(len(norm.w)) >= len(words.w))),
sh AS MATERIALIZED ({_shingled("covered", "t")}),
size AS (SELECT t, count(*) AS n FROM sh GROUP BY t),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.t AS a, y.t AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.t <> y.t GROUP BY 1, 2)
  JOIN size p ON p.t = a JOIN size q ON q.t = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(t, g) AS (SELECT t, t FROM covered UNION SELECT l.b, reach.g FROM reach JOIN links l ON l.a = reach.t),
voter AS (SELECT text, min(g)::VARCHAR AS vote FROM reach JOIN covered USING (t) GROUP BY text),
votes AS MATERIALIZED (SELECT host, array_to_string(w, ' ') AS k, coalesce(vote, text || chr(10) || 'by text') AS vote FROM norm LEFT JOIN voter USING (text)),
freq AS (
  SELECT host, k FROM (SELECT host, k, count(DISTINCT vote) AS n FROM votes GROUP BY ALL) WHERE n >= 8
  UNION SELECT h.host, k FROM (SELECT k, count(DISTINCT vote) AS n FROM votes GROUP BY ALL), (SELECT DISTINCT host FROM docs) h WHERE n >= 8),
gone AS (SELECT r, count(*) AS n_removed_lines, sum(len(w)) AS n_removed_words FROM norm JOIN freq ON norm.host = freq.host AND array_to_string(w, ' ') = k GROUP BY r),
dup AS (SELECT r, sum(n - 1) AS n_dup_lines FROM (SELECT r, line, count(*) AS n FROM norm GROUP BY r, line) GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_removed_words, 0) AS n_removed_words
  FROM docs JOIN words USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 10 AND 2 * (n_words - n_removed_words) >= n_words AS kept FROM judged"""

OP11_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT row_number() OVER () AS r, part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e
  FROM texts LEFT JOIN marks USING (doc_id)),
fails AS (SELECT part, good, bad, unnest([a, b, c, d, e]) AS failed, unnest(['A', 'B', 'C', 'D', 'E']) AS f, r FROM docs),
kinds AS (SELECT part, good, bad, m, count(*) AS n FROM (SELECT r, any_value(part) AS part, any_value(good) AS good, any_value(bad) AS bad,
    coalesce(string_agg(f, '' ORDER BY f) FILTER (failed), '') AS m FROM fails GROUP BY r) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, i AS step, o[i] AS filter, o[:i - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS i)),
judged AS (SELECT k.*, o, step, filter, contains(m, filter) AS failed, len(list_intersect(string_split(m, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AND m <> '' AS gone FROM kinds k, steps),
counted AS (
  SELECT part, o AS filter_order, step, any_value(filter) AS filter, coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (failed AND gone), 0) AS redundant, coalesce(sum(n) FILTER (m = filter), 0) AS unique_fails,
    coalesce(sum(n) FILTER (failed AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (failed AND NOT gone AND bad), 0) AS toxic_lost
  FROM judged GROUP BY part, o, step)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id,
  positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op4_near_duplicates": OP4_SQL, "op6_decontamination": OP6_SQL, "op9_line_rules": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_hard_negatives": OP12_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
