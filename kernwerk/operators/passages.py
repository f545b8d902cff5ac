"""Articles to passages, dense ids, and passages to evidence, as distributed operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from kernwerk.functions import prose
from kernwerk.functions.text import SKIPPED_SECTIONS, normalize_title
from kernwerk.session import cut_lineage


def _strings(f):
    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t) for t in texts.tolist()], dtype="object")

    return run


_PASSAGE = ArrayType(StructType([StructField("section", StringType()), StructField("text", StringType())]))


def chunker():
    @F.pandas_udf(_PASSAGE)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else [{"section": a, "text": b} for a, b in prose.chunk(t, SKIPPED_SECTIONS)] for t in texts.tolist()], dtype="object")

    return run


def passages(articles: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, section, text): the passages of each article in order; articles without text have none."""
    return articles.select(key, F.posexplode(chunker()(F.col(text))).alias("ordinal", "p")).select(key, "ordinal", "p.section", "p.text")


def dense_ids(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Ids 0, 1, 2, … in the given order, without bringing all rows into one task.

    Rows are split by ranges of the order; each range is numbered by itself, and its start is the sum of the ranges before it: one number
    for each partition, a table as small as the number of partitions.
    """
    n = partitions or df.sparkSession.sparkContext.defaultParallelism * 4
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))  # written once: a second sampling of ranges could cut elsewhere
    local = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_start", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_start")
    return local.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop("_part", "_row", "_start")


def pack_tables(articles: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, passages) of a pack: ids dense from 0 in reading order, with first_passage and n_passages; articles without passages drop out.

    ``articles`` has key, title, qid, popularity, url_title; ``rows`` has key, ordinal, section, text.
    """
    counts = rows.groupBy("key").agg(F.count("*").alias("n_passages"))
    kept = dense_ids(articles.join(counts, "key"), ["key"], "article_id")
    p = dense_ids(rows.join(kept.select("key", "article_id"), "key"), ["article_id", "ordinal"], "passage_id")
    first = p.groupBy("article_id").agg(F.min("passage_id").alias("first_passage"))
    meta = kept.join(first, "article_id").select("article_id", "title", "qid", F.greatest("popularity", F.lit(0)).alias("popularity"), "url_title", "first_passage", "n_passages", normalize_title(F.col("title")).alias("title_norm"))
    return meta, p.select("passage_id", "article_id", F.least("ordinal", F.lit(65_535)).alias("ordinal"), F.col("section").alias("section_path"), "text")


def subset(articles: DataFrame, rows: DataFrame, n: int, leads_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The n most popular articles with new dense ids; all their passages or the leads alone."""
    top = articles.orderBy(F.desc("popularity"), "article_id").limit(n)
    keyed = top.withColumn("key", F.col("article_id"))
    kept = rows.join(keyed.select("key", F.col("article_id")), "article_id", "left_semi").withColumn("key", F.col("article_id")).select("key", "ordinal", F.col("section_path").alias("section"), "text")
    return pack_tables(keyed.select("key", "title", "qid", "popularity", "url_title"), kept.where("ordinal = 0") if leads_only else kept)


_SHOWN = ArrayType(StructType([StructField("place", IntegerType()), StructField("shown", StringType())]))


def evidence(hits: DataFrame, budget: int) -> DataFrame:
    """(query_id, n, pid, shown): the hits of each question that fit the token budget, in rank order, numbered from 1.

    The pick depends on what came before it, so a question's hits (a pool of at most some dozen) are listed and scanned together.
    """

    @F.pandas_udf(_SHOWN)
    def pick(texts: pd.Series, queries: pd.Series) -> pd.Series:
        return pd.Series([[{"place": i, "shown": s} for i, s in prose.pack_evidence(list(t), budget, q or "")] for t, q in zip(texts.tolist(), queries.tolist())], dtype="object")

    listed = hits.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "pid", "text"))).alias("h"))
    picked = listed.withColumn("p", pick(F.transform("h", lambda x: x["text"]), F.col("query")))
    return picked.select("query_id", "h", F.posexplode("p").alias("i", "s")).select("query_id", (F.col("i") + 1).alias("n"), F.get("h", F.col("s.place"))["pid"].alias("pid"), "s.shown")


_SEGMENTS = ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType()), StructField("n", IntegerType())]))


def citation_segments():
    """A function of (answer, number of sources, known numbers)."""

    @F.pandas_udf(_SEGMENTS)
    def run(answers: pd.Series, sources: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "text": t, "n": n} for k, t, n in prose.check_citations(a or "", int(s), set(e if e is not None else ()))] for a, s, e in zip(answers.tolist(), sources.tolist(), numbers.tolist())], dtype="object")

    return run


def supported_segments():
    """A function of (answer, number of sources, known numbers, evidence, rarities of the answer's terms): a sentence without a citation must have
    enough of its terms, weighted by rarity, in the evidence."""

    @F.pandas_udf(_SEGMENTS)
    def run(answers: pd.Series, sources: pd.Series, numbers: pd.Series, evidence: pd.Series, rarity: pd.Series) -> pd.Series:
        out = []
        for a, s, e, text, r in zip(answers.tolist(), sources.tolist(), numbers.tolist(), evidence.tolist(), rarity.tolist()):
            known, weight = set(prose.term_list(text or "")), dict(r) if r is not None else {}
            got = prose.check_citations(a or "", int(s), set(e if e is not None else ()), lambda x: prose.supported(x, weight, known))  # noqa: B023
            out.append([{"kind": k, "text": t, "n": n} for k, t, n in got])
        return pd.Series(out, dtype="object")

    return run


def citation_stats(segments: DataFrame) -> DataFrame:
    """Per answer: text and unverified segments, and distinct sources cited."""
    s = segments.select("id", F.explode_outer("segments").alias("s"))
    return s.groupBy("id").agg(F.count_if(F.col("s.kind") != "cite").alias("parts"), F.count_if(F.col("s.kind") == "unverified").alias("unverified"), F.countDistinct(F.when(F.col("s.kind") == "cite", F.col("s.n"))).alias("cited"))


# Arrow UDFs over the pure functions.
core_sentences = _strings(prose.sentences)
claims = _strings(prose.claims)
text_pieces = _strings(prose.pieces)
