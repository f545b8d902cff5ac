"""Inverted index and multi-field BM25 as joins and aggregations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernwerk.functions.text import tokens
from kernwerk.session import cut_lineage, replicated, salted, stored

K1, B = 1.2, 0.75
BOOSTS = {"title": 3.0, "section": 1.5, "body": 1.0, "questions": 2.0}
MAX_TOKEN = 40
BUCKETS, SALTS = 16, 4
# The English stop words of the usual index analyzer.
INDEX_STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def analyze(c):
    """Lower-case tokens of at most MAX_TOKEN characters without stop words. No stemming: the corpus has several languages."""
    stop = F.array(*[F.lit(w) for w in INDEX_STOP_WORDS])
    return F.filter(tokens(c), lambda w: (F.length(w) <= MAX_TOKEN) & ~F.array_contains(stop, w))


def postings(passages: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, term, pid, tf, len): term frequencies of each field of each passage; ``fields`` maps an index field to a column."""
    rows = passages.select(F.col("pid"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), analyze(F.coalesce(F.col(c), F.lit(""))).alias("t")) for f, c in fields.items()])).alias("x"))
    flat = rows.select("pid", F.col("x.field").alias("field"), F.size("x.t").alias("len"), F.explode("x.t").alias("term"))
    return flat.groupBy("field", "term", "pid", "len").agg(F.count("*").alias("tf"))


def field_stats(passages: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, n, avg_len): passages and mean length of each field: one row for each field."""
    sizes = [F.struct(F.lit(f).alias("field"), F.size(analyze(F.coalesce(F.col(c), F.lit("")))).alias("len")) for f, c in fields.items()]
    return passages.select(F.explode(F.array(*sizes)).alias("x")).groupBy("x.field").agg(F.count("*").alias("n"), F.avg("x.len").alias("avg_len"))


@dataclass(frozen=True)
class Index:
    """Postings and field statistics, made once and asked often."""

    postings: DataFrame
    stats: DataFrame


def store(passages: DataFrame, fields: dict[str, str]) -> Index:
    """The index of passages as a table in the shared folder, in BUCKETS directories by a hash of the term: questions read only the buckets of
    their terms. The postings of a frequent term are spread over several files of its bucket."""
    rows = postings(passages, fields).withColumn("bucket", bucket(F.col("term")))
    spread = rows.repartition("bucket", F.pmod(F.xxhash64("pid"), F.lit(SALTS)))
    written = stored(spread, "postings", "bucket")
    sizes = written.groupBy("field").agg(F.sum("tf").alias("all"))  # the texts are read once: their lengths are the sums of their terms
    n = passages.agg(F.count("*").alias("n"), F.array(*[F.lit(f) for f in fields]).alias("f")).select("n", F.explode("f").alias("field"))
    stats = n.join(sizes, "field", "left").select("field", "n", (F.coalesce("all", F.lit(0)) / F.col("n")).alias("avg_len"))
    return Index(written, cut_lineage(stats))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bm25_scores(index: DataFrame, stats: DataFrame, queries: DataFrame, lists: dict[str, tuple[str, ...]], k1: float = K1, b: float = B, boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """(query_id, pid, one score for each of ``lists``): boosted BM25 in micro units, a query's terms OR-ed over the fields of a list.

    Only postings of query terms are scored: the join on the term meets them before the shuffle by passage. Several lists, such as all fields
    and the titles alone, come from one pass; a passage without a hit in a list has a null score there. A query without terms has no hits.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(analyze(F.col("query")))).alias("term"))
    terms = asked.select("term").distinct()
    if "bucket" in index.columns:  # a stored index: only the directories of the asked terms are read
        some = [r["b"] for r in terms.select(bucket(F.col("term")).alias("b")).distinct().collect()]  # at most BUCKETS numbers
        known = index.where(F.col("bucket").isin(some)).drop("bucket").join(terms, "term", "left_semi")
    else:
        known = index.join(terms, "term", "left_semi")
    df = known.groupBy("field", "term").agg(F.count("*").alias("df"))
    weight = F.create_map(*[x for f, w in boosts.items() for x in (F.lit(f), F.lit(w))])[F.col("field")]
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = known.join(df, ["field", "term"]).join(F.broadcast(stats), "field").select("term", "pid", "field", part.alias("part"))  # stats: one row a field
    total = lambda fields: F.floor(F.sum(F.when(F.col("field").isin(*fields), F.col("part"))) * 1e6 + 0.5).cast("long")
    met = salted(scored, "pid", SALTS).join(replicated(asked, SALTS), ["term", "_salt"])  # the postings of a common term are scored in several tasks
    return met.groupBy("query_id", "pid").agg(*[total(fields).alias(name) for name, fields in lists.items()])


def ranked(scores: DataFrame, name: str, k: int) -> DataFrame:
    """(query_id, pid, score_micro, rank): the k best passages of each query in one list; ties go to the smaller pid."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score_micro"), "pid"))
    return scores.where(F.col(name).isNotNull()).select("query_id", "pid", F.col(name).alias("score_micro")).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def bm25(index: DataFrame, stats: DataFrame, queries: DataFrame, k: int, fields: tuple[str, ...] = tuple(BOOSTS)) -> DataFrame:
    """The k best passages of each query over some fields."""
    return ranked(bm25_scores(index, stats, queries, {"score": fields}), "score", k)


def rarity(index: DataFrame, n_passages: DataFrame) -> DataFrame:
    """(term, df, rarity): ln(N / (1 + df)) of body terms, not below 0."""
    df = index.where("field = 'body'").groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n_passages.agg(F.count("*").alias("n")))).select("term", "df", F.greatest(F.log(F.col("n") / (1 + F.col("df"))), F.lit(0.0)).alias("rarity"))  # one row
