"""Order-dependent looks at events and conversations: runs, look-back, recent rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Consecutive equal values as runs: (by, run, value, n, start, stop)."""
    w = Window.partitionBy(by).orderBy(*order)
    new = F.coalesce((F.col(value) != F.lag(value).over(w)), F.lit(True)).cast("int")
    marked = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w).cast("long"))
    return marked.groupBy(by, "run").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(order[0]).alias("start"), F.max(order[0]).alias("stop"))


def look_back(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """The value of the turn before, and the last one that is not null of the two turns before."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("recent", F.last(value, ignorenulls=True).over(w.rowsBetween(-2, -1)))


def ring(rows: DataFrame, by: str, order: list, n: int = 20) -> DataFrame:
    """The latest n rows of each group, newest first; ``place`` from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("place") <= n)
