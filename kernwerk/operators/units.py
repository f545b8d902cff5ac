"""Quantities recorded in different units: one number in the property's common unit, and agreeing pairs across units."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kernwerk.functions.keys import entity_key, strip_all
from kernwerk.functions.unitgrammar import NONE, Unit, clean_unit, convert, parse_unit
from kernwerk.functions.values import number_after, number_value
from kernwerk.session import cut_lineage, replicated, salted

SALTS = 4


def _resolve(unit: str | None, tail: str | None, common: str | None) -> tuple[Unit, Unit] | None:
    """(unit of the value, common unit); None if the unit is not one of the field's dimension."""
    base = parse_unit(common or "")
    if base is None:
        return None
    named, after = clean_unit(unit), clean_unit(tail)
    of_tail = parse_unit(after, base.dims) if after else NONE
    if named and named != "1":
        got = parse_unit(named, base.dims)
        if got is not None and of_tail is not None and of_tail.name == "" and of_tail.scale != 1.0:  # "2.3 million" with the unit apart
            got = Unit(got.scale * of_tail.scale, got.factor, got.offset, got.dims, got.name)
        if got is not None and got.name == "" and of_tail is not None and of_tail.name not in ("", "1"):  # the scale apart, the unit in the text
            got = Unit(got.scale * of_tail.scale, of_tail.factor, of_tail.offset, of_tail.dims, of_tail.name)
    else:
        got = of_tail
    if got is None:
        return None
    if got.name in ("", "1"):  # no unit, or a scale alone: it counts the common unit
        got = Unit(got.scale, base.factor, base.offset, base.dims, base.name)
    return (got, base) if got.dims == base.dims else None


@F.pandas_udf(StructType([StructField("value", DoubleType()), StructField("unit_key", StringType())]))
def _to_common(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    known: dict = {}
    for number, unit, tail, common in parts:
        values, keys = [], []
        for v, *texts in zip(number.tolist(), unit.tolist(), tail.tolist(), common.tolist()):
            key = tuple(texts)
            if key not in known:
                if len(known) > 100_000:
                    known.clear()
                known[key] = _resolve(*texts)
            got = known[key]
            ok = got is not None and v is not None and v == v
            values.append(convert(v, *got) if ok else None)
            keys.append(got[0].key if ok else None)
        yield pd.DataFrame({"value": pd.Series(values, dtype="float64"), "unit_key": keys})


def quantities(facts: DataFrame, props: DataFrame, unit_name: DataFrame) -> DataFrame:
    """Each quantity fact with ``value_common`` (in props.common_unit) and ``unit_key`` (equal for spellings of one unit and scale).

    The unit is in ``unit`` (a name, or a key of unit_name), else after the number in ``value_text``, else the common unit. A key that
    unit_name does not name, and a unit of another dimension than the property's, give no value and the row drops out; so do null and NaN
    numbers. Repeated facts count once; of contradicting rows of one fact_id each stays. Both lookup tables are small and fixed; they broadcast by their size, which the optimizer checks.
    """
    p = props.where(F.col("datatype") == "quantity").select(entity_key(F.col("pid"), "P").alias("pid"), F.col("common_unit")).groupBy("pid").agg(F.min("common_unit").alias("_common"))
    names = (
        unit_name.where(F.trim(F.col("unit")) != "")
        .groupBy(entity_key(F.col("qid"), "Q").alias("_unit_key"))
        .agg(F.min(strip_all(F.col("unit"))).alias("_unit_named"))
    )
    keyed = strip_all(F.col("unit")).rlike(r"(?i)^(?:.*[^a-z0-9])?q\d+$")
    rows = (
        facts.select("fact_id", entity_key(F.col("qid"), "Q").alias("qid"), entity_key(F.col("pid"), "P").alias("pid"), "point_in_time", "value_num", "value_text", "unit")
        .join(p, "pid")
        .withColumn("_number", number_value(F.col("value_num"), F.col("value_text")))
        .where(F.col("_number").isNotNull())
        .withColumn("_unit_key", F.when(keyed, entity_key(F.col("unit"), "Q")))
        .join(names, "_unit_key", "left")
    )
    unit = F.when(F.col("_unit_key").isNotNull(), F.coalesce(F.col("_unit_named"), F.lit("?"))).otherwise(F.col("unit"))
    done = rows.withColumn("_c", _to_common(F.col("_number"), unit, number_after(F.col("value_text")), F.col("_common")))
    return done.where(F.col("_c.value").isNotNull() & F.col("qid").isNotNull()).select("fact_id", "qid", "pid", "point_in_time", F.col("_common").alias("common_unit"), F.col("_c.value").alias("value_common"), F.col("_c.unit_key").alias("unit_key")).distinct()


def agreeing_pairs(values: DataFrame, tolerance: float = 0.01, salts: int = SALTS) -> DataFrame:
    """Pairs (fact_id_a < fact_id_b) of one qid, pid and point_in_time, in different units or scales, within ``tolerance`` of the larger.

    A band join: values fall into logarithmic buckets as wide as the tolerance, so that partners are in the same or the next bucket. Groups
    in which all values have one unit have no pairs and drop out; in the others each value meets, of the units that come after its own, the
    values of one unit at a time, so that however many statements of one unit a group has, they do not meet each other. Zero agrees with
    zero only. Null point_in_time equals null. The converted values are written once (a few short columns of what was read). A hot group is
    spread over ``salts`` tasks when its units are looked up, and over its buckets and units when its values meet.
    """
    import math

    width = -math.log(1.0 - tolerance) * 1.0001
    v = F.col("value_common")
    bucket = F.when(v == 0, F.lit(None)).otherwise(F.floor(F.log(F.abs(v)) / width))
    group = ["qid", "pid", "_pit"]
    base = values.select("fact_id", "qid", "pid", F.coalesce(F.concat(F.lit("="), F.col("point_in_time")), F.lit("")).alias("_pit"), v.alias("_v"), F.xxhash64("unit_key").alias("_u"), F.signum(v).cast("int").alias("_sign"), F.coalesce(bucket, F.lit(0)).cast("long").alias("_b"))
    base = cut_lineage(base)
    units = base.groupBy(*group).agg(F.collect_set("_u").alias("_units")).where(F.size("_units") > 1)  # at most as many as there are units
    mixed = cut_lineage(salted(base, "fact_id", salts).join(replicated(units, salts), [*group, "_salt"]).drop("_salt"))
    near = lambda c: F.when(F.col("_sign") == 0, F.array(c)).otherwise(F.array(c - 1, c, c + 1))
    a = mixed.select(*group, "_sign", "_b", F.explode(F.filter("_units", lambda u: u > F.col("_u"))).alias("_u"), F.col("fact_id").alias("_fa"), F.col("_v").alias("_va"))
    b = mixed.where(F.col("_u") > F.array_min("_units")).select(*group, "_sign", F.explode(near(F.col("_b"))).alias("_b"), "_u", F.col("fact_id").alias("_fb"), F.col("_v").alias("_vb"))
    close = F.abs(F.col("_va") - F.col("_vb")) <= F.lit(tolerance) * F.greatest(F.abs(F.col("_va")), F.abs(F.col("_vb"))) * (1 + 1e-12)
    met = a.join(b, [*group, "_sign", "_b", "_u"]).where(close & (F.col("_fa") != F.col("_fb")))
    return met.select(F.least("_fa", "_fb").alias("fact_id_a"), F.greatest("_fa", "_fb").alias("fact_id_b")).distinct()


def unit_report(values: DataFrame) -> DataFrame:
    """Per property: facts, units seen, smallest and largest value in the common unit."""
    return values.groupBy("pid", "common_unit").agg(F.count("*").alias("n"), F.countDistinct("unit_key").alias("n_units"), F.min("value_common").alias("lo"), F.max("value_common").alias("hi"))
