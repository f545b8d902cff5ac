"""The N best items of every group, also of groups with millions of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernwerk.session import cut_lineage, replicated

STEPS = 64  #: histogram buckets for each factor e of the score
SALTS = 16


def score_bucket(score: Column) -> Column:
    """A bucket that never decreases with the score, for any double: no scan for the range is needed, and a group has few buckets."""
    return F.floor(F.signum(score) * F.log1p(F.abs(score) * 1e9) * STEPS).cast("long")


def best_scores(scored: DataFrame, group: list[str], item: list[str], score: str) -> DataFrame:
    """One row per item and group with its highest score; null and NaN are no scores. Hashes on (group, item), so a hot group is spread."""
    s = F.col(score).cast("double")
    return scored.where(s.isNotNull() & ~F.isnan(s)).groupBy(*group, *item).agg(F.max(s).alias("_score"))


def top_n(scored: DataFrame, group: list[str], item: list[str], score: str, n: int, salts: int = SALTS) -> DataFrame:
    """Rows (group…, item…, _score, _rank) of the ``n`` best distinct items per group; ties go to the smaller item columns, in their order.

    1. Each item's highest score (repeated rows count once). 2. A histogram of scores per group, counted partly before the shuffle, gives the
    lowest bucket that still leaves at least ``n`` items above it. 3. Items below that bucket drop out, joined on (group, salt) so that no
    task holds a hot group whole. 4. The few survivors are ranked exactly. A group with fewer than ``n`` items keeps all of them; a bucket
    that holds many equal scores survives as a whole and is cut by the exact rank, whose limit runs before its shuffle too.
    Null group or item values are values of their own here; the caller filters groups it does not want.
    """
    best = cut_lineage(best_scores(scored, group, item, score).withColumn("_bucket", score_bucket(F.col("_score"))))  # written once, read for the histogram and for the filter
    counts = best.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(Window.partitionBy(*group).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1))
    floor = counts.withColumn("_above", F.coalesce(above, F.lit(0))).where(F.col("_above") < n).groupBy(*group).agg(F.min("_bucket").alias("_floor"))
    salt = F.pmod(F.xxhash64(*item), F.lit(salts)).cast("int")
    a, b = best.withColumn("_salt", salt).alias("a"), replicated(floor, salts).alias("b")
    same = F.col("a._salt") == F.col("b._salt")
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    kept = a.join(b, same & (F.col("a._bucket") >= F.col("b._floor"))).select(*[F.col(f"a.{c}") for c in [*group, *item, "_score"]])
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_score"), *[F.asc(c) for c in item]))
    return kept.withColumn("_rank", rank).where(F.col("_rank") <= n)


def top_candidates(records: DataFrame, cand: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best passages (pack, passage_id) of each query text, exactly as written.

    Null and empty texts are no groups; candidates whose record is not there drop out; an item's score is its highest rrf in all records.
    In place of its text a group is carried by two hashes of 64 bits, so that no text is shuffled with the candidates.
    """
    marks = [F.xxhash64("query").alias("_g"), F.xxhash64(F.lit(1), "query").alias("_h")]
    texts = records.where(F.col("query").isNotNull() & (F.col("query") != "") & F.col("record_id").isNotNull()).select("record_id", "query")
    rows = cand.select("record_id", "pack", "passage_id", "rrf").join(texts.select("record_id", *marks).distinct(), "record_id")
    best = top_n(rows, ["_g", "_h"], ["pack", "passage_id"], "rrf", n)
    return best.join(texts.select("query").distinct().select("query", *marks), ["_g", "_h"]).drop("_g", "_h")
