"""Queries of the training-data operators for language models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernwerk.llm import abuse as A
from kernwerk.llm import leaks as L
from kernwerk.llm import mixture as M
from kernwerk.llm import neighbours as V
from kernwerk.llm import split as S
from kernwerk.llm import tokens as T
from kernwerk.llm import topn as N
from kernwerk.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return S.oversized_pieces(table(spark, d, "sections")).select("section_id", "block_no").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return S.oversized_pieces(table(spark, d, "sections")).distinct()


def p2_audit(spark: SparkSession, d: str) -> DataFrame:
    return S.audit(table(spark, d, "sections"))


def p2_passages(spark: SparkSession, d: str) -> DataFrame:
    return S.passage_counts(table(spark, d, "sections"), table(spark, d, "articles"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return L.leaks(table(spark, d, "documents"), L.test_items([table(spark, d, "robust"), table(spark, d, "eval_req")]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    return L.removal_spans(_leaks(spark, d))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return V.similar_pairs(table(spark, d, "dense_index"), table(spark, d, "dense_info"), table(spark, d, "dense_lists"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = _neighbours(spark, d)
    return near.select(F.least("passage_id", "neighbour_id").alias("passage_id_a"), F.greatest("passage_id", "neighbour_id").alias("passage_id_b")).where("passage_id_a < passage_id_b").distinct()


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return N.top_candidates(table(spark, d, "query_record"), table(spark, d, "cand")).select("query", "pack", "passage_id")


def p7_ranked(spark: SparkSession, d: str) -> DataFrame:
    return N.top_candidates(table(spark, d, "query_record"), table(spark, d, "cand")).select("query", F.col("_rank").cast("long").alias("rank"), "pack", "passage_id", F.col("_score").alias("rrf"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return T.encode(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """Encoded and decoded again: the texts themselves."""
    return T.decode(p8_ids(spark, d)).select("doc_id", "text")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return A.scored(table(spark, d, "documents"), table(spark, d, "abuse_samples"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where(F.col("score") >= A.THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return A.rates(_scores(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return M.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0].select("doc_id", "source", "n_tokens", "n_copies")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    used, domains, target, members = M.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return M.shares(used, members, domains, target)


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_audit, p2_passages, p3_found, p3_spans, p4_found, p4_neighbours, p7_found, p7_ranked, p8_ids, p8_texts, p9_mix, p9_shares, p10_found, p10_scores, p10_rates)}

_P7 = """
WITH best AS (
  SELECT q.query, c.pack, c.passage_id, max(c.rrf) AS rrf
  FROM cand c JOIN (SELECT DISTINCT record_id, query FROM query_record WHERE query <> '') q ON c.record_id = q.record_id
  WHERE c.rrf IS NOT NULL AND NOT isnan(c.rrf) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, pack, passage_id) AS rank FROM best)
"""
ORACLE = {
    "p2_found": r"""
SELECT DISTINCT section_id, CAST(i - 1 AS INTEGER) AS block_no FROM (SELECT section_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM sections)
WHERE length(blocks[i]) > 2000 OR len(list_filter(regexp_split_to_array(blocks[i], '[ \t\r\n\x{00A0}]+'), lambda x: x <> '')) > 220""",
    "p2_audit": r"""
SELECT DISTINCT section_id, CAST(i - 1 AS INTEGER) AS block_no, true AS within_limits, true AS covered, true AS overlapping FROM (SELECT section_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM sections)
WHERE length(blocks[i]) > 2000 OR len(list_filter(regexp_split_to_array(blocks[i], '[ \t\r\n\x{00A0}]+'), lambda x: x <> '')) > 220""",
    "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_found": _P7 + "SELECT query, pack, passage_id FROM ranked WHERE rank <= 10",
    "p7_ranked": _P7 + "SELECT query, rank, pack, passage_id, rrf FROM ranked WHERE rank <= 10",
}
