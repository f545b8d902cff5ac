"""Entity-attribute-value rows into one typed row for each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernwerk.functions.keys import entity_key, strip_all
from kernwerk.functions.values import is_placeholder, number_value, parse_date, point_year
from kernwerk.session import bounded_rows

MAX_ATTRIBUTES = 2000


def usable(datatype: Column) -> Column:
    """Whether a fact has a value of its property's type."""
    number = number_value(F.col("value_num"), F.col("value_text")).isNotNull()
    date = parse_date(F.col("value_text")).isNotNull()
    return F.when(datatype == "quantity", number).when(datatype == "time", date).otherwise(~is_placeholder(F.col("value_text")))


def typed_facts(facts: DataFrame, props: DataFrame) -> DataFrame:
    """Facts of known properties with a usable value, keys in normal form, and what ranks them."""
    p = props.select(entity_key(F.col("pid"), "P").alias("pid"), "datatype").where(F.col("pid").isNotNull()).groupBy("pid").agg(F.min("datatype").alias("datatype"))
    return (
        facts.select(F.col("fact_id").cast("long").alias("fact_id"), entity_key(F.col("qid"), "Q").alias("qid"), entity_key(F.col("pid"), "P").alias("pid"), "value_num", "value_text", F.col("rank"), "point_in_time")
        .join(p, "pid")
        .where(usable(F.col("datatype")) & F.col("qid").isNotNull() & F.col("fact_id").isNotNull())
    )


def attributes(rows: DataFrame, limit: int = MAX_ATTRIBUTES) -> list[tuple[str, str]]:
    """(pid, datatype) of the attributes that occur, in order: one aggregation over all rows. A schema has at most ``limit`` of them; more raise."""
    return sorted((r["pid"], r["datatype"]) for r in bounded_rows(rows.groupBy("pid").agg(F.min("datatype").alias("datatype")), limit, "attributes"))


def best_facts(rows: DataFrame, values: bool = True) -> DataFrame:
    """(qid, pid, best): of the facts of one cell the one of the highest rank, then of the latest year (null earliest), then of the smallest fact_id.

    ``best`` is a struct that ends in fact_id and, if ``values`` are wanted, the fact's value; equal facts do not change it.
    """
    order = [(-F.coalesce(F.col("rank"), F.lit(-1))).alias("r"), (-F.coalesce(point_year(F.col("point_in_time")), F.lit(-1_000_000_000))).alias("y"), F.col("fact_id")]
    return rows.groupBy("qid", "pid").agg(F.min(F.struct(*order, *(["value_num", "value_text"] if values else []))).alias("best"))


def pivot_cells(rows: DataFrame, pids: list[str], values: bool = True) -> DataFrame:
    """One row per qid with one struct<…, fact_id, value_num, value_text> column per attribute (without ``values`` it ends in fact_id); null where the entity has no usable fact.

    Each cell is resolved first, with partial aggregation before the shuffle, so that an entity with very many facts arrives as one row for each
    task and attribute; then one grouping has a conditional aggregation for each attribute. An empty input gives no rows.
    """
    return best_facts(rows, values).groupBy("qid").agg(*[F.min(F.when(F.col("pid") == p, F.col("best"))).alias(p) for p in pids]) if pids else rows.select("qid").distinct()


def wide_table(rows: DataFrame, attrs: list[tuple[str, str]]) -> DataFrame:
    """One row per entity: quantity as double, time as struct<year, month, day>, the others as trimmed text."""

    def typed(pid: str, datatype: str) -> Column:
        c = F.col(f"`{pid}`")
        if datatype == "quantity":
            return number_value(c["value_num"], c["value_text"]).alias(pid)
        if datatype == "time":
            return parse_date(c["value_text"]).alias(pid)
        return strip_all(c["value_text"]).alias(pid)

    return pivot_cells(rows, [p for p, _ in attrs]).select("qid", *[typed(p, d) for p, d in attrs])


def filled_cells(rows: DataFrame, attrs: list[tuple[str, str]]) -> DataFrame:
    """(qid, pid, fact_id) of each filled cell of the wide table."""
    if not attrs:
        return rows.select("qid", "pid", "fact_id").where(F.lit(False))
    wide = pivot_cells(rows, [p for p, _ in attrs], values=False)
    cells = F.array(*[F.struct(F.lit(p).alias("pid"), F.col(f"`{p}`")["fact_id"].alias("fact_id")) for p, _ in attrs])
    return wide.select("qid", F.explode(F.filter(cells, lambda x: x["fact_id"].isNotNull())).alias("c")).select("qid", "c.pid", "c.fact_id")
