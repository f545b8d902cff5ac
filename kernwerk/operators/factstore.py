"""The fact store: best and current statements, one value for each property, lookups, relevance, hops and derived values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernwerk.functions.text import fact_line, format_number
from kernwerk.session import small

MAX_ITEMS, MAX_PROPERTIES = 6, 10_000


def best_rank(rows: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """Statements of the highest rank of their group; all of them where several share it."""
    return rows.withColumn("_best", F.max(rank).over(Window.partitionBy(*keys))).where(F.col(rank) == F.col("_best")).drop("_best")


def current(rows: DataFrame, keys: list[str], ended: str, at: str) -> DataFrame:
    """Statements that are as open as any of their group and as late as any of it.

    Both conditions are evaluated on the same input, so a group whose latest statement has ended, while an earlier one has not, loses all its rows.
    """
    w = Window.partitionBy(*keys)
    time = F.coalesce(F.col(at), F.lit(""))
    flag = F.col(ended).cast("int")
    return rows.withColumn("_open", F.min(flag).over(w)).withColumn("_late", F.max(time).over(w)).where((flag == F.col("_open")) & (time == F.col("_late"))).drop("_open", "_late")


def first_values(value: Column, order: Column, n: int = MAX_ITEMS, sep: str = ", ") -> Column:
    """The first ``n`` distinct values by their first occurrence, joined."""
    listed = F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))), lambda x: x["v"])
    return F.array_join(F.slice(F.array_distinct(listed), 1, n), sep)


def one_per_property(rows: DataFrame, order: str, list_types: tuple[str, ...] = ("wikibase-item", "monolingualtext")) -> DataFrame:
    """One row per (qid, pid): the first number, text and unit that are not null; item and text types list their first six values."""
    o = F.col(order)
    text = F.when(F.min("datatype").isin(*list_types), F.nullif(first_values(F.col("value_text"), o), F.lit(""))).otherwise(F.min_by("value_text", F.when(F.col("value_text").isNotNull(), o)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), o)).alias(c)
    return rows.groupBy("qid", "pid").agg(first("value_num"), text.alias("value_text"), first("unit"), F.min("point_in_time").alias("point_in_time"), F.max("rank").alias("rank"))


def labels(rows: DataFrame, key: str, value: str, priority: Column) -> DataFrame:
    """The value of the smallest priority for each key; ties go to the smaller value."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(priority, F.col(value))).alias("label"))


def entity_facts(facts: DataFrame, props: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` facts of each entity by priority: one per property, its best ranked and latest statement with a value.

    Statements without a value are skipped before the pick. Times compare as text, null last.
    """
    has = F.col("value_num").isNotNull() | F.col("value_text").isNotNull()
    rows = facts.where(has).join(props, "pid")
    pick = F.row_number().over(Window.partitionBy("qid", "pid").orderBy(F.desc("rank"), F.desc_nulls_last("point_in_time"), F.asc("fact_id")))
    one = rows.withColumn("_p", pick).where("_p = 1")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("priority", "pid"))
    return one.withColumn("place", place.cast("long")).where(F.col("place") <= limit).drop("_p")


def shown_value() -> Column:
    """A number with its unit, else the text."""
    n = format_number(F.col("value_num"))
    return F.when(F.col("value_num").isNotNull(), F.when(F.coalesce(F.col("unit"), F.lit("")) != "", F.concat_ws(" ", n, F.col("unit"))).otherwise(n)).otherwise(F.col("value_text"))


def informative(entity: Column, label: Column, value: Column) -> Column:
    """Facts that say something: not the entity's own name, nor one of three labels that every entity has."""
    return ~label.isin("instance of", "official name", "country") & (F.lower(value) != F.lower(entity))


def relevance(queries: DataFrame, props: DataFrame) -> DataFrame:
    """(query_id, pid, relevance): cosine of question and property less the question's mean over all properties. Both vectors are unit length."""
    dot = F.aggregate(F.zip_with("q", "p", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    pairs = queries.crossJoin(small(props, MAX_PROPERTIES, "properties")).withColumn("cos", dot)  # a stated set against a checked one
    return pairs.select("query_id", "pid", (F.col("cos") - F.avg("cos").over(Window.partitionBy("query_id"))).alias("relevance"))


def two_hops(facts: DataFrame, names: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """(qid, via_pid, bridge, pid, value): the text of a fact, looked up as an entity's name, leads to a fact of that entity."""
    a = facts.where(F.col("pid").isin(first) & F.col("value_text").isNotNull()).select("qid", F.col("pid").alias("via_pid"), F.lower("value_text").alias("name"))
    b = names.select(F.lower("label").alias("name"), F.col("qid").alias("bridge"))
    c = facts.where(F.col("pid").isin(second)).select(F.col("qid").alias("bridge"), "pid", F.coalesce(F.col("value_text"), F.col("value_num").cast("string")).alias("value"))
    return a.join(b, "name").join(c, "bridge").select("qid", "via_pid", "bridge", "pid", "value").distinct()


def ratio(facts: DataFrame, over: str, under: str) -> DataFrame:
    """(qid, ratio): one numeric property over another, per entity, of the first values; a zero divisor gives no row."""
    v = lambda p: F.min_by(F.when(F.col("pid") == p, F.col("value_num")), F.when((F.col("pid") == p) & F.col("value_num").isNotNull(), F.col("fact_id")))
    got = facts.where(F.col("pid").isin(over, under) & ~F.isnan("value_num")).groupBy("qid").agg(v(over).alias("a"), v(under).alias("b"))
    return got.where(F.col("a").isNotNull() & (F.col("b") != 0)).select("qid", (F.col("a") / F.col("b")).alias("ratio"))


def compare(values: DataFrame, n: int = 2) -> DataFrame:
    """Per property, the values of compared entities side by side: larger, difference and quotient."""
    return values.groupBy("pid").agg(F.max("value").alias("larger"), F.min("value").alias("smaller"), F.count("*").alias("n")).where(F.col("n") >= n).select("pid", "larger", "smaller", (F.col("larger") - F.col("smaller")).alias("difference"), F.when(F.col("smaller") != 0, F.col("larger") / F.col("smaller")).alias("quotient"))


def lines(rows: DataFrame, entity: str, label: str, value: str, at: str) -> DataFrame:
    return rows.withColumn("line", fact_line(F.col(entity), F.col(label), F.col(value), F.col(at)))


def unit_shown(facts: DataFrame, overrides: DataFrame, codes: DataFrame, labels: DataFrame) -> DataFrame:
    """``facts`` with the unit as it is shown: of the entity key at the end of ``unit`` the override, else the code, else the label, else the key
    itself; a unit without a key stays as written. The three tables have qid and unit; the first of several by the alphabet counts."""
    key = F.regexp_extract(F.coalesce("unit", F.lit("")), r"Q\d+$", 0)
    named = lambda df, name: df.where(F.trim("unit") != "").groupBy(F.col("qid").alias("_unit_key")).agg(F.min(F.trim("unit")).alias(name))
    rows = facts.withColumn("_unit_key", F.nullif(key, F.lit("")))
    for df, name in ((overrides, "_override"), (codes, "_code"), (labels, "_label")):
        rows = rows.join(named(df, name), "_unit_key", "left")
    return rows.withColumn("unit_shown", F.coalesce("_override", "_code", "_label", "_unit_key", "unit")).drop("_unit_key", "_override", "_code", "_label")


def comparison_lines(values: DataFrame) -> DataFrame:
    """(query_id, line) for each question that compares two entities by one number: its difference and its quotient, and which is greater.

    ``values`` has query_id, place (0 and 1), entity, label, value, unit; units must agree, and a quotient by zero is left out.
    """
    a, b = (values.where(F.col("place") == i).select("query_id", F.col("entity").alias(f"e{i}"), F.col("label").alias(f"l{i}"), F.col("value").alias(f"v{i}"), F.coalesce("unit", F.lit("")).alias(f"u{i}")) for i in (0, 1))
    j = a.join(b, "query_id").where((F.col("l0") == F.col("l1")) & (F.col("u0") == F.col("u1")) & F.col("v0").isNotNull() & F.col("v1").isNotNull())
    two = lambda x: format_number(F.when(F.abs(x) < 0.01, x).otherwise(F.round(x, 2)))
    unit = F.when(F.col("u0") != "", F.concat(F.lit(" "), F.col("u0"))).otherwise("")
    sign = F.when(F.col("v0") > F.col("v1"), " > ").when(F.col("v0") < F.col("v1"), " < ").otherwise(" = ")
    order = F.concat("l0", F.lit(": "), "e0", sign, "e1")
    gap = F.concat("l0", F.lit(" of "), "e0", F.lit(" − "), "e1", F.lit(" = "), two(F.col("v0") - F.col("v1")), unit)
    ratio_ = F.when(F.col("v1") != 0, F.concat("l0", F.lit(" of "), "e0", F.lit(" ÷ "), "e1", F.lit(" = "), two(F.col("v0") / F.col("v1"))))
    return j.select("query_id", F.posexplode(F.filter(F.array(order, gap, ratio_), lambda x: x.isNotNull())).alias("ord", "line"))


def travel_lines(lengths: DataFrame) -> DataFrame:
    """(query_id, line): hours and days that a length takes at a stated speed; ``lengths`` has query_id, entity, label, metres, shown, speed (m/s)."""
    hours = F.col("metres") / F.col("speed") / 3600
    two = lambda x: format_number(F.when(F.abs(x) < 0.01, x).otherwise(F.round(x, 2)))
    line = F.concat("label", F.lit(" of "), "entity", F.lit(" = "), "shown", F.lit(": "), two(hours), F.lit(" hours = "), two(hours / 24), F.lit(" days"))
    return lengths.where((F.col("speed") > 0) & F.col("metres").isNotNull()).select("query_id", line.alias("line"))
