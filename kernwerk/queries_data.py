"""Queries of the general training-data operators: units (p1), orphan references (p5), wide tables (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernwerk.functions.keys import entity_key
from kernwerk.operators import orphans as O
from kernwerk.operators import units as U
from kernwerk.operators import wide as W
from kernwerk.session import table


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    return U.quantities(table(spark, d, "facts"), table(spark, d, "props"), table(spark, d, "unit_name"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return U.agreeing_pairs(_quantities(spark, d))


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    return _quantities(spark, d)


def _refs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    articles, entities = table(spark, d, "articles"), table(spark, d, "entities")
    to_article = O.references(table(spark, d, "redirects"), "redirects", "redirect_id", F.col("article_id"), "seen_at")
    to_entity = O.union_all([O.references(articles, "articles", "article_id", entity_key(F.col("qid"), "Q"), "added_at"), O.references(table(spark, d, "facts"), "facts", "fact_id", entity_key(F.col("qid"), "Q"), "seen_at")])
    # One pass for both kinds of targets: article keys are plain numbers, entity keys start with Q, so they cannot clash.
    targets = O.union_all([O.lives(articles, F.col("article_id"), "added_at", "removed_at"), O.lives(entities, entity_key(F.col("qid"), "Q"), "first_seen", "deleted_at")])
    prefixed = lambda kind, df: df.withColumn("key", F.concat(F.lit(kind), F.col("key")))
    refs = O.union_all([prefixed("article:", to_article), prefixed("entity:", to_entity)])
    kind = F.when(F.col("key").startswith("Q"), F.concat(F.lit("entity:"), F.col("key"))).otherwise(F.concat(F.lit("article:"), F.col("key")))
    return refs, targets.withColumn("key", kind)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    refs, targets = _refs(spark, d)
    return O.orphans(refs, targets).select("ref_table", "ref_id").distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    refs, targets = _refs(spark, d)
    return O.orphan_counts(O.orphans(refs, targets), refs)


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return W.typed_facts(table(spark, d, "facts"), table(spark, d, "props"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _typed(spark, d)
    return W.filled_cells(rows, W.attributes(rows))


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    rows = _typed(spark, d)
    return W.wide_table(rows, W.attributes(rows))


QUERIES = {f.__name__: f for f in (p1_found, p1_values, p5_found, p5_counts, p6_found, p6_wide)}

_QID = r"""CASE WHEN regexp_extract({c}, '(?:^|[^A-Za-z0-9])[Qq]0*(\d+)[\s\x{{00A0}}]*$', 1) <> '' THEN 'Q' || regexp_extract({c}, '(?:^|[^A-Za-z0-9])[Qq]0*(\d+)[\s\x{{00A0}}]*$', 1) ELSE nullif(regexp_replace({c}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g'), '') END"""
_PID = _QID.replace("[Qq]", "[Pp]").replace("'Q'", "'P'")
_P5 = f"""
WITH refs AS (
  SELECT DISTINCT 'redirects' AS ref_table, redirect_id AS ref_id, CAST(article_id AS VARCHAR) AS key, seen_at AS ts FROM redirects WHERE article_id IS NOT NULL
  UNION SELECT DISTINCT 'articles', article_id, {_QID.format(c="qid")}, added_at FROM articles
  UNION SELECT DISTINCT 'facts', fact_id, {_QID.format(c="qid")}, seen_at FROM facts),
lives AS (
  SELECT DISTINCT 'redirects' AS t, CAST(article_id AS VARCHAR) AS key, added_at AS f, removed_at AS e FROM articles
  UNION SELECT DISTINCT 'x', {_QID.format(c="qid")}, first_seen, deleted_at FROM entities),
bad AS (
  SELECT r.*, NOT EXISTS (SELECT 1 FROM lives l WHERE l.key = r.key AND (l.t = 'redirects') = (r.ref_table = 'redirects')) AS missing FROM refs r
  WHERE r.key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lives l WHERE l.key = r.key AND (l.t = 'redirects') = (r.ref_table = 'redirects') AND l.f <= r.ts AND (l.e IS NULL OR l.e > r.ts)))
"""
_MONTHS = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
ORACLE = {
    "p5_found": _P5 + "SELECT DISTINCT ref_table, ref_id FROM bad",
    "p5_counts": _P5
    + """SELECT a.ref_table, a.month, a.n_refs, coalesce(b.n_orphans, 0)::BIGINT AS n_orphans, coalesce(b.n_missing, 0)::BIGINT AS n_missing
FROM (SELECT ref_table, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n_refs FROM refs WHERE key IS NOT NULL GROUP BY 1, 2) a
LEFT JOIN (SELECT ref_table, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n_orphans, count(*) FILTER (missing) AS n_missing FROM bad GROUP BY 1, 2) b
ON a.ref_table = b.ref_table AND a.month IS NOT DISTINCT FROM b.month""",
    "p6_found": f"""
WITH f AS (
  SELECT DISTINCT fact_id, {_QID.format(c="qid")} AS qid, {_PID.format(c="pid")} AS pid, value_num, regexp_replace(value_text, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') AS t, rank,
    CASE WHEN point_in_time LIKE '%BC' THEN -CAST(regexp_extract(point_in_time, '^(\\d+)', 1) AS INT) WHEN point_in_time IS NULL THEN -1000000000 ELSE CAST(regexp_extract(point_in_time, '^(\\d+)', 1) AS INT) END AS yr
  FROM facts),
u AS (
  SELECT f.*, p.datatype FROM f JOIN (SELECT DISTINCT pid, datatype FROM props) p ON f.pid = p.pid
  WHERE f.qid IS NOT NULL AND CASE p.datatype
    WHEN 'quantity' THEN (value_num IS NOT NULL AND NOT isnan(value_num)) OR coalesce(regexp_matches(t, '\\d'), false)
    WHEN 'time' THEN coalesce(try_strptime(t, ['%d %B %Y', '%B %d, %Y', '%Y-%m-%d']) IS NOT NULL OR regexp_full_match(t, '(?i){_MONTHS} \\d{{1,4}}|[1-9]\\d{{0,3}}( BC)?'), false)
    ELSE t IS NOT NULL AND lower(t) NOT IN ('', '-', '–', '—', '?', '??', 'n/a', 'na', 'none', 'null', 'unknown', 'tbd', 'undated', 'circa unknown', 'see note', 'varies') END)
SELECT qid, pid, fact_id FROM u QUALIFY row_number() OVER (PARTITION BY qid, pid ORDER BY rank DESC, yr DESC, fact_id) = 1""",
}
