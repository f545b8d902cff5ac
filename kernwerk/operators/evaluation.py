"""Evaluation: retrieval measures, paired comparisons, run summaries and gates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_at(ranked: DataFrame, gold: DataFrame, by: str, item: str, ks: tuple[int, ...]) -> DataFrame:
    """Share of a question's gold items among its first k; ``ranked`` has ``rank`` from 1. Questions without gold do not appear."""
    g = gold.select(by, item).distinct()
    first = ranked.groupBy(by, item).agg(F.min("rank").alias("rank"))
    return g.join(first, [by, item], "left").groupBy(by).agg(F.count("*").alias("n_gold"), *[(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in ks])


def hit_at(ranked: DataFrame, by: str, relevant: str, ks: tuple[int, ...]) -> DataFrame:
    """Whether any of the first k rows is relevant, and the first relevant rank."""
    best = F.min(F.when(F.col(relevant), F.col("rank")))
    return ranked.groupBy(by).agg(best.alias("first"), *[F.coalesce(best <= k, F.lit(False)).alias(f"hit_{k}") for k in ks])


def ndcg_at(graded: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    """nDCG and precision at k: gain 2^grade − 1, discount log2(rank + 1), rank from 1; missing grades are 0."""
    gain = F.pow(F.lit(2.0), F.coalesce(F.col("grade"), F.lit(0))) - 1
    ideal = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.coalesce("grade", F.lit(0))), *ties))
    rows = graded.withColumn("_g", gain).withColumn("_i", ideal)
    part = lambda r: F.sum(F.when(r <= k, F.col("_g") / F.log2(r + 1)).otherwise(0.0))
    out = rows.groupBy(by).agg(part(F.col("rank")).alias("dcg"), part(F.col("_i")).alias("ideal"), (F.count_if((F.col("rank") <= k) & (F.col("_g") > 0)) / k).alias("precision"))
    return out.select(by, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).alias("ndcg"), "precision")


def auc(rows: DataFrame, by: str, score: str, positive: str) -> DataFrame:
    """P(positive above negative) + half of ties, by average ranks: counts per score value, no pairs."""
    v = rows.groupBy(by, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = v.withColumn("_b", below).groupBy(by).agg(F.sum(F.col("p") * (F.col("_b") + F.col("n") / 2)).alias("w"), F.sum("p").alias("np"), F.sum("n").alias("nn"))
    return won.where((F.col("np") > 0) & (F.col("nn") > 0)).select(by, (F.col("w") / (F.col("np") * F.col("nn"))).alias("auc"))


def log_choose(n: Column, k: Column) -> Column:
    return F.expr("0D") + F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), F.lit(0.0), lambda acc, i: acc + F.log((n - k + i) / i))


def sign_p(wins: Column, losses: Column) -> Column:
    """Two-sided exact probability of a split at least as uneven, if wins and losses are equally likely; 1 without either."""
    n, low = (wins + losses).cast("long"), F.least(wins, losses).cast("long")
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), low), F.lit(0.0), lambda acc, i: acc + F.exp(log_choose(n, i) - n * F.log(F.lit(2.0))))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def pairwise(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b, diff, outcome) of two runs on the same questions."""
    j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    diff = F.col("a") - F.col("b")
    return j.select(key, "a", "b", diff.alias("diff"), F.when(diff > 0, "win").when(diff < 0, "loss").otherwise("tie").alias("outcome"))


def order_outcome(first: Column, second: Column) -> Column:
    """A win or loss only if neither order of presentation prefers the other side; else a tie."""
    return F.when((first >= 0) & (second >= 0) & (first + second > 0), "win").when((first <= 0) & (second <= 0) & (first + second < 0), "loss").otherwise("tie")


def pairwise_summary(rows: DataFrame) -> DataFrame:
    s = rows.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "win").alias("win"), F.count_if(F.col("outcome") == "tie").alias("tie"), F.count_if(F.col("outcome") == "loss").alias("loss"), F.avg("diff").alias("mean_diff"), F.count_if(F.col("diff") == 0).alias("identical"))
    return s.withColumn("sign_p", sign_p(F.col("win"), F.col("loss")))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that look random, from 64 bits: a public finaliser of multiplications and shifts."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap(values: DataFrame, value: str, key: str, n: int = 10_000, seed: int = 0) -> DataFrame:
    """(mean, low, high): a 95 % interval of the mean by Poisson resampling.

    Each row weighs, in each of n resamples, as often as a Poisson(1) number from the hash of its ``key``, which is unique, says, so the
    interval does not depend on the layout. A task adds up all resamples of its rows; n partial sums a task are what is shuffled.
    """
    seen = F.xxhash64(key, F.lit(seed))
    rows = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), seen.alias("i"))
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])

    def resample(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, n))
        for part in parts:
            v, ids = part["v"].to_numpy(), part["i"].to_numpy().astype(np.uint64)
            for a in range(0, len(v), 256):
                for b in range(0, n, 4096):
                    which = np.arange(b, min(n, b + 4096), dtype=np.uint64)
                    u = _mixed(_mixed(ids[a : a + 256])[:, None] + which[None, :] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
                    w = np.searchsorted(edges, u * 2.0**-53)
                    sums[0, b : b + len(which)] += v[a : a + 256] @ w
                    sums[1, b : b + len(which)] += w.sum(axis=0)
        yield pd.DataFrame({"b": np.arange(n), "s": sums[0], "w": sums[1]})

    per = rows.mapInPandas(resample, "b int, s double, w double").groupBy("b").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    ci = per.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return rows.agg(F.avg("v").alias("mean")).crossJoin(ci).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))  # one row each


def nearest_rank(rows: DataFrame, group: str, value: str, ps: tuple[float, ...]) -> DataFrame:
    """(group, p, value): for each p the value at index round((n − 1) p) of the group's sorted values; halves round up. Nulls do not count.

    A histogram of each group tells in which bucket the index lies; only the distinct values of that bucket are put in order.
    """
    v = F.col(value).cast("double")
    bucket = F.floor(F.signum(v) * F.log1p(F.abs(v)) * 64).cast("long")
    seen = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(F.col(group).alias("g"), v.alias("v"), bucket.alias("b")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    bins = seen.groupBy("g", "b").agg(F.sum("n").alias("n")).withColumn("end", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("g")))
    asked = bins.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps]))).withColumn("at", F.floor((F.col("all") - 1) * F.col("p") + 0.5))
    asked = asked.where((F.col("at") >= F.col("end") - F.col("n")) & (F.col("at") < F.col("end"))).select(F.col("g").alias("h"), F.col("b").alias("c"), "p", (F.col("at") - F.col("end") + F.col("n")).alias("off"))
    inside = seen.join(asked, F.col("g").eqNullSafe(F.col("h")) & (F.col("b") == F.col("c")))
    end = F.sum("n").over(Window.partitionBy("g", "b", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("end", end).where((F.col("off") >= F.col("end") - F.col("n")) & (F.col("off") < F.col("end"))).select(F.col("g").alias(group), "p", F.col("v").alias("value"))


def judged_summary(rows: DataFrame, group: str) -> DataFrame:
    """The measures of judged answers for each group and overall (null group): scores of both sides and the ratio of their means, outcomes,
    sufficiency of the evidence (full, partial, none) also of lost answers, sentence checks, expectations, abstentions and decoding rates.

    Columns that do not apply to a row are null there. A mean or share over nothing is null.
    """
    judged, labelled = F.col("outcome").isNotNull(), F.col("sufficiency").isNotNull()
    share = lambda a, b: F.when(b > 0, a / b)
    ours, base = F.avg(F.when(judged, F.col("ours"))), F.avg(F.when(judged, F.col("baseline")))
    lost = judged & (F.col("outcome") == "loss") & labelled
    return rows.rollup(group).agg(
        F.grouping(group).cast("long").alias("overall"), F.count("*").alias("n"), F.count_if(judged).alias("n_judged"), ours.alias("ours"), base.alias("baseline"), share(ours, base).alias("score_ratio"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("win", "tie", "loss")], *[F.count_if(F.col("sufficiency") == x).alias(f"evidence_{x}") for x in ("full", "partial", "none")],
        F.count_if(lost & (F.col("sufficiency") == "full")).alias("lost_with_full"), F.count_if(lost & (F.col("sufficiency") != "full")).alias("lost_with_thin"), F.avg(F.col("n_relevant") / F.nullif(F.col("n_sources"), F.lit(0))).alias("relevant_share"),
        *[share(F.sum(c), F.sum("sentences")).alias(f"{c}_rate") for c in ("unverified", "uncited")], F.avg("cites").alias("cites"), F.count("expect_ok").alias("expect_n"), F.count_if("expect_ok").alias("expect_pass"), share(F.count_if("expect_ok"), F.count("expect_ok")).alias("expect_rate"),
        F.count("abstain_ok").alias("abstain_n"), F.count_if("abstain_ok").alias("abstain_pass"), F.sum(F.coalesce("invented", F.lit(0))).alias("invented"), F.percentile(F.when(F.col("decode_ms") > 0, F.col("gen_tokens") / F.col("decode_ms") * 1000), F.lit(0.5)).alias("decode_rate"), F.count("error").alias("errors"),
    )


def gate_checks(new: DataFrame, old: DataFrame, pairs: DataFrame, rolls: int = 1, slack: float = 0.01) -> DataFrame:
    """(check, ok): the six release checks of a run against another. ``new`` and ``old`` are rows as for ``judged_summary`` with ``canary``;
    ``pairs`` has an outcome for each question. No errors; every canary right, and there is one; the rate of unverified sentences within the
    slack; no fewer expected answers; no more than ``rolls`` fewer abstentions; no significant loss in pairs, and there are some. A check
    that has nothing to compare is left out.
    """
    rest = F.col("canary").isNull() | ~F.col("canary")

    def counts(df: DataFrame, p: str) -> DataFrame:
        rate = F.sum(F.when(rest, F.col("unverified"))) / F.nullif(F.sum(F.when(rest, F.col("sentences"))), F.lit(0))
        return df.agg(F.count("error").alias(f"{p}_errors"), F.count_if("canary").alias(f"{p}_canary"), F.count_if(F.col("canary") & F.coalesce("expect_ok", F.lit(False))).alias(f"{p}_right"), rate.alias(f"{p}_unverified"), *[x for c in ("expect", "abstain") for x in (F.count_if(rest & F.col(f"{c}_ok").isNotNull()).alias(f"{p}_{c}_n"), F.count_if(rest & F.coalesce(f"{c}_ok", F.lit(False))).alias(f"{p}_{c}"))])

    j = counts(new, "new").crossJoin(counts(old, "old")).crossJoin(pairwise_summary(pairs))  # one row each
    worse = (F.col("loss") > F.col("win")) & (F.col("sign_p") < 0.05)
    checks = {
        "errors": F.col("new_errors") == 0,
        "canary": (F.col("new_canary") > 0) & (F.col("new_right") == F.col("new_canary")),
        "unverified": F.when(F.col("new_unverified").isNotNull() & F.col("old_unverified").isNotNull(), F.col("new_unverified") <= F.col("old_unverified") + slack),
        "expected": F.when(F.col("new_expect_n") > 0, F.col("new_expect") >= F.col("old_expect")),
        "abstention": F.when(F.col("new_abstain_n") > 0, F.col("new_abstain") >= F.col("old_abstain") - rolls),
        "pairs": (F.col("n") > 0) & ~worse,
    }
    return j.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in checks.items()])).alias("c")).select("c.check", "c.ok").where("ok is not null")


def run_summary(rows: DataFrame, group: str) -> DataFrame:
    """Counts, rates and latencies for each group and overall (null group), in one pass."""
    return rows.rollup(group).agg(
        F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("n_sources") == 0).alias("no_sources"), F.avg("n_sources").alias("mean_sources"), F.avg("evidence_tokens").alias("mean_tokens"),
        F.percentile("total_ms", F.lit(0.5)).alias("p50"), F.percentile("total_ms", F.lit(0.9)).alias("p90"), F.percentile("ttft_ms", F.lit(0.5)).alias("first_p50"), F.grouping(group).cast("long").alias("overall"),
    )


def release_gate(new: DataFrame, old: DataFrame, slack: float = 0.01) -> DataFrame:
    """(check, ok): the new run has no more errors, and neither its share without sources nor its median time is worse by more than the slack."""
    f = lambda df, p: df.agg(F.count_if(F.col("error").isNotNull()).alias(f"{p}e"), (F.count_if(F.col("n_sources") == 0) / F.count("*")).alias(f"{p}u"), F.percentile("total_ms", F.lit(0.5)).alias(f"{p}t"))
    j = f(new, "n").crossJoin(f(old, "o"))  # one row each
    checks = {"errors": F.col("ne") <= F.col("oe"), "unsourced": F.col("nu") <= F.col("ou") + slack, "median_time": F.col("nt") <= F.col("ot") * (1 + slack)}
    return j.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in checks.items()])).alias("c")).select("c.check", "c.ok")


def stratified(rows: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """About n rows, each group by its share with the largest remainders rounded up; within a group by hash, so the pick is repeatable."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    quota = F.col("_n") * n / F.sum("_n").over(Window.partitionBy(F.lit(0)))
    q = sizes.withColumn("_q", quota).withColumn("_f", F.floor("_q").cast("long"))
    left = F.lit(n) - F.sum("_f").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("_q") - F.col("_f")), group))
    take = q.withColumn("_take", F.col("_f") + F.when(place <= left, 1).otherwise(0)).select(group, "_take")
    pick = F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key))
    return rows.join(F.broadcast(take), group).withColumn("_p", pick).where(F.col("_p") <= F.col("_take")).drop("_p", "_take")  # one row a group


def round_robin(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n rows, taken in turn from each group."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("turn", turn.cast("long")).orderBy("turn", group).limit(n)
