"""Units, orphans and wide tables: edges, ties, repeated rows, empty tables, clashing columns, and brute force."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kernwerk.operators import orphans as O
from kernwerk.operators import units as U
from kernwerk.operators import wide as W

FACTS = "fact_id long, qid string, pid string, value_num double, value_text string, unit string, point_in_time string, rank int"
PROPS = [("P1", "length", 1, "quantity", "m"), ("P2", "born", 2, "time", None), ("P3", "country", 3, "wikibase-item", None), ("P4", "people", 4, "quantity", None)]


@pytest.fixture(scope="module")
def props(spark):
    return spark.createDataFrame(PROPS, "pid string, label string, priority int, datatype string, common_unit string")


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("Q77", "foot"), ("Q77", None), ("Q78", None)], "qid string, unit string")


def facts(spark, rows):
    return spark.createDataFrame([tuple(r) + (None,) * (8 - len(r)) for r in rows], FACTS)


def pairs(spark, rows, props, names):
    return sorted(map(tuple, U.agreeing_pairs(U.quantities(facts(spark, rows), props, names)).collect()))


def test_units(spark, props, names):
    rows = [(1, "Q1", "P1", 1000.0, None, "m"), (2, "q01", "p1", 1.0, None, "km"), (2, "q01", "p1", 1.0, None, "km"), (3, "Q1", "P1", None, "3280.84 ft", None), (4, "Q1", "P1", 1000.0, None, None), (5, "Q1", "P1", float("nan"), "1 km", None), (6, "Q1", "P1", 1.0, None, "kg"), (7, "Q1", "P1", 3280.84, None, "Q77"), (8, "Q1", "P1", 1.0, None, "Q78"), (9, "Q1", "P1", None, None, "m"), (10, None, "P1", 1.0, None, "km"), (11, "Q1", "P1", 1000.0, None, "metres"), (12, "Q1", "P1", None, "x" * 100_000, None)]
    got = pairs(spark, rows, props, names)
    assert got == [(1, 2), (1, 3), (1, 5), (1, 7), (2, 3), (2, 4), (2, 7), (2, 11), (3, 4), (3, 5), (3, 11), (4, 5), (4, 7), (5, 7), (5, 11), (7, 11)]  # 1, 4 and 11 share a unit; so do 2 and 5, and 3 and 7


def test_units_brute_force(spark, props, names):
    import random

    rng = random.Random(3)
    rows = [(i, f"Q{rng.randint(1, 3)}", "P1", rng.choice([0.0, 1.0, -1.0]) * 1.004 ** rng.randint(0, 40), None, rng.choice(["m", "ft", "yd"]), rng.choice([None, "2000"])) for i in range(150)]
    f = {"m": 1.0, "ft": 0.3048, "yd": 0.9144}
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[6] == b[6] and a[5] != b[5] and abs(a[3] * f[a[5]] - b[3] * f[b[5]]) <= 0.01 * max(abs(a[3] * f[a[5]]), abs(b[3] * f[b[5]])) * (1 + 1e-12))
    assert pairs(spark, rows, props, names) == want


def test_units_long_texts(spark, props, names):
    after = "kilometres according to the survey of the land office, " + "which was made by hand and never repeated, " * 4
    assert len(after) > 200
    rows = [(1, "Q1", "P1", 1000.0, None, "m"), (2, "Q1", "P1", 1.0, None, after), (3, "Q1", "P1", None, f"1 {after}", None), (4, "Q1", "P1", 1.0, None, "word " * 60)]
    assert pairs(spark, rows, props, names) == [(1, 2), (1, 3)]


def test_units_hot_group(spark, props, names):
    """Many statements of one unit do not meet each other: only the pairs across units come out, and no task holds the group."""
    n = 30_000
    hot = spark.range(n).select(F.col("id").alias("fact_id"), F.lit("Q1").alias("qid"), F.lit("P1").alias("pid"), F.when(F.col("id") < 3, 0.001).otherwise(1.0).alias("value_num"), F.lit(None).cast("string").alias("value_text"), F.when(F.col("id") < 3, "km").otherwise("m").alias("unit"), F.lit(None).cast("string").alias("point_in_time"), F.lit(1).alias("rank"))
    assert U.agreeing_pairs(U.quantities(hot, props, names)).count() == 3 * (n - 3)


def test_units_contradicting_rows(spark, props, names):
    rows = [(1, "Q1", "P1", 1000.0, None, "m"), (1, "Q1", "P1", 2.0, None, "km"), (2, "Q1", "P1", 1.0, None, "km"), (3, "Q1", "P1", 2000.0, None, "m")]
    assert pairs(spark, rows, props, names) == [(1, 2), (1, 3), (2, 3)][:2] and len(pairs(spark, rows[1:], props, names)) == 1


def test_units_empty(spark, props, names):
    assert pairs(spark, [], props, names) == []


def day(n):
    return dt.datetime(2024, 1, n)


def test_orphans(spark):
    refs = spark.createDataFrame([("t", 1, "a", day(5)), ("t", 1, "a", day(5)), ("t", 2, "a", day(1)), ("t", 3, "zz", day(5)), ("t", 4, "b", day(12)), ("t", 5, "b", day(9)), ("t", 6, "c", None), ("t", 7, "zz", None), ("t", 8, "b", day(10)), ("t", 9, "b", day(21))], "ref_table string, ref_id long, key string, at timestamp_ntz")
    targets = spark.createDataFrame([("a", day(2), None), ("b", day(3), day(10)), ("b", day(20), None), ("c", day(2), None)], "key string, from timestamp_ntz, to timestamp_ntz")
    got = {(r.ref_id, r.reason) for r in O.orphans(refs, targets).collect()}
    assert got == {(2, "not live"), (3, "missing"), (4, "not live"), (7, "missing"), (8, "not live")}
    assert O.orphans(refs, targets.limit(0)).select("ref_id").distinct().count() == 9
    assert O.orphans(refs.limit(0), targets).count() == 0
    counts = {(r.month, r.n_refs, r.n_orphans, r.n_missing) for r in O.orphan_counts(O.orphans(refs, targets), refs).collect()}
    assert counts == {(dt.date(2024, 1, 1), 7, 4, 1), (None, 2, 1, 1)}


def test_orphans_brute_force(spark):
    import random

    rng = random.Random(11)
    t = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 300))
    lives = [(rng.choice("abc"), *sorted((t(), t()))) for _ in range(60)] + [("d", t(), None)]
    refs = [("t", i, rng.choice("abcde"), t()) for i in range(400)]
    got = {r.ref_id for r in O.orphans(spark.createDataFrame(refs, "ref_table string, ref_id long, key string, at timestamp_ntz"), spark.createDataFrame(lives, "key string, from timestamp_ntz, to timestamp_ntz")).collect()}
    assert got == {i for _, i, k, at in refs if not any(k == x and a <= at and (b is None or b > at) for x, a, b in lives)}


def test_orphans_hot_key(spark):
    refs = spark.range(20_000).select(F.lit("t").alias("ref_table"), F.col("id").alias("ref_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.lit(day(5)).alias("at"))
    targets = spark.createDataFrame([("hot", day(6), None)], "key string, from timestamp_ntz, to timestamp_ntz")
    assert O.orphans(refs, targets).count() == 20_000


def test_orphans_hot_moment(spark):
    """One key, one moment, very many references, some before and some after the end of a life."""
    refs = spark.range(30_000).select(F.lit("t").alias("ref_table"), F.col("id").alias("ref_id"), F.lit("hot").alias("key"), F.when(F.col("id") % 3 == 0, F.lit(day(9))).otherwise(F.lit(day(5))).alias("at"))
    targets = spark.createDataFrame([("hot", day(2), day(9)), ("hot", day(3), day(4)), ("hot", day(20), None)], "key string, from timestamp_ntz, to timestamp_ntz")
    got = O.orphans(refs, targets)
    assert got.count() == 10_000 and got.where("ref_id % 3 <> 0 or reason <> 'not live'").count() == 0


def test_wide(spark, props):
    rows = [(1, "Q1", "P1", 5.0, None, None, "2000", 1), (2, "Q1", "P1", 6.0, None, None, "2001", 1), (3, "Q1", "P1", 7.0, None, None, "2001", 1), (3, "Q1", "P1", 7.0, None, None, "2001", 1), (4, "Q1", "P1", None, None, None, "2020", 2), (5, "Q1", "P2", None, "31 April 1733", None, None, 2), (6, "q1", "P2", None, "679 BC", None, None, 1), (7, "Q1", "P3", None, "n/a", None, None, 2), (8, "Q1", "P3", None, " Peru ", None, "44 BC", 1), (9, "Q2", "P9", 1.0), (10, "Q2", "P4", None, "2.5 million", None, None, None), (11, None, "P1", 1.0)]
    f = facts(spark, rows).withColumn("datatype", F.lit("clash")).withColumn("_r", F.lit(1))
    typed = W.typed_facts(f, props)
    attrs = W.attributes(typed)
    assert attrs == [("P1", "quantity"), ("P2", "time"), ("P3", "wikibase-item"), ("P4", "quantity")]
    assert {tuple(r) for r in W.filled_cells(typed, attrs).collect()} == {("Q1", "P1", 2), ("Q1", "P2", 6), ("Q1", "P3", 8), ("Q2", "P4", 10)}
    wide = {r.qid: r for r in W.wide_table(typed, attrs).collect()}
    assert wide["Q1"].P1 == 6.0 and wide["Q1"].P2.year == -679 and wide["Q1"].P3 == "Peru" and wide["Q2"].P4 == 2.5
    empty = W.typed_facts(f.limit(0), props)
    assert W.attributes(empty) == [] and W.filled_cells(empty, []).count() == 0
    with pytest.raises(ValueError):
        W.attributes(typed, limit=2)
