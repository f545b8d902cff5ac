"""References to records that do not exist, are deleted, or only arrive later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kernwerk.session import cut_lineage, replicated, salted

SALTS = 16


def references(df: DataFrame, ref_table: str, ref_id: str, key, at: str) -> DataFrame:
    """Rows (ref_table, ref_id, key, at) of one referring table; null keys refer to nothing and drop out."""
    return df.select(F.lit(ref_table).alias("ref_table"), F.col(ref_id).cast("long").alias("ref_id"), key.cast("string").alias("key"), F.col(at).alias("at")).where(F.col("key").isNotNull())


def lives(df: DataFrame, key, start: str, end: str) -> DataFrame:
    """Rows (key, from, to): the periods in which a target exists, from ``start`` (included) to ``end`` (not included; null is open)."""
    return df.select(key.cast("string").alias("key"), F.col(start).alias("from"), F.col(end).alias("to")).where(F.col("key").isNotNull() & F.col("from").isNotNull()).distinct()


def orphans(refs: DataFrame, targets: DataFrame, salts: int = SALTS) -> DataFrame:
    """The references (ref_table, ref_id, key, at, reason) without a target that lives at their time; reason is 'missing' or 'not live'.

    1. The distinct keys of the references, with their earliest and latest time: one partial aggregation, in which a hot key shrinks to one
       row for each task. 2. A left anti-join drops the keys that some single life of the target covers from the earliest to the latest time;
       most keys end here. 3. The rest (missing keys, and keys with a gap) joins back to the references on (key, salt), so that one hot key
       is spread over ``salts`` tasks. 4. Where the key has lives, they and its references are put in order of key and time, in ranges of about
       equal size: the latest end among the lives begun so far tells whether one is open. What earlier ranges of a key leave open is carried
       from range to range, so that neither a key with very many references, even at one moment, nor one with very many lives meets in one
       task or in pairs.
    A reference without a time counts only if its key has no life at all. Repeated rows count once, also where only some of a row's
    repetitions are orphans (a row with several versions is an orphan if one version is). An empty target table makes every reference one.
    """
    spans = refs.groupBy("key").agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"))
    inside = (F.col("_lo").isNull() | (F.col("c.from") <= F.col("_lo"))) & (F.col("c.to").isNull() | F.col("_hi").isNull() | (F.col("c.to") > F.col("_hi")))
    open_keys = spans.alias("s").join(targets.alias("c"), (F.col("s.key") == F.col("c.key")) & inside, "left_anti").select("key")
    suspects = cut_lineage(open_keys.join(targets.select("key").distinct().withColumn("_has", F.lit(True)), "key", "left"))
    rows = cut_lineage(salted(refs, "ref_id", salts).join(replicated(suspects, salts), ["key", "_salt"]).select("ref_table", "ref_id", "key", "at", "_has"))  # few, and read three times
    missing = rows.where(F.col("_has").isNull()).select("ref_table", "ref_id", "key", "at", F.lit("missing").alias("reason"))

    asked = rows.where(F.col("_has") & F.col("at").isNotNull()).select("ref_table", "ref_id", "key", F.col("at").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(targets.schema["to"].dataType).alias("_to"))
    end = F.coalesce("to", F.lit("9999-12-31 00:00:00").cast(targets.schema["to"].dataType))
    begun = targets.join(suspects.where("_has"), "key", "left_semi").select(F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("long").alias("ref_id"), "key", F.col("from").alias("_t"), F.lit(0).alias("_kind"), end.alias("_to"))
    events = asked.unionByName(begun).repartitionByRange("key", "_t", "_kind", "ref_id").withColumn("_part", F.spark_partition_id())
    events = cut_lineage(events)  # the ranges are written, so that a lost executor cannot move a row to another one
    parts = events.groupBy("key", "_part").agg(F.max("_to").alias("_m"))
    carry = parts.select("key", "_part", F.max("_m").over(Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    so_far = F.max("_to").over(Window.partitionBy("key", "_part").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = events.withColumn("_now", so_far).where("_kind = 1").join(carry, ["key", "_part"], "left")
    last = F.greatest("_now", "_carry")
    dead = held.where(last.isNull() | (last <= F.col("_t"))).select("ref_table", "ref_id", "key", F.col("_t").alias("at"), F.lit("not live").alias("reason"))
    return missing.unionByName(dead).distinct()


def orphan_counts(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Per table and month: references, orphans and orphans whose key exists at no time. Rows without a time have a null month."""
    month = F.date_trunc("month", F.col("at")).cast("date").alias("month")
    per = refs.distinct().groupBy("ref_table", month).agg(F.count("*").alias("n_refs"))
    bad = found.groupBy("ref_table", month).agg(F.count("*").alias("n_orphans"), F.count_if(F.col("reason") == "missing").alias("n_missing"))
    a, b = per.alias("a"), bad.alias("b")
    return a.join(b, (F.col("a.ref_table") == F.col("b.ref_table")) & F.col("a.month").eqNullSafe(F.col("b.month")), "left").select("a.ref_table", "a.month", "n_refs", F.coalesce("n_orphans", F.lit(0)).cast("long").alias("n_orphans"), F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
