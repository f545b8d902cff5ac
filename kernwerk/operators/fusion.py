"""Rank fusion: reciprocal ranks, priors, the features of a learned scorer, pool cuts and diverse picks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, W_SPARSE, W_DENSE, W_ENTITY, PRIOR_WEIGHT = 60.0, 1.0, 1.0, 2.0, 0.005
FUSE_KEEP, PER_ARTICLE, DEPTH, PACK_DEPTH, KEYWORD_KEEP = 40, 4, 150, 10, 5
POPULARITY_LOG = math.log(1 + 1e7)
MISSING_RANK = 1000


def reciprocal(rank: Column, k: float = RRF_K) -> Column:
    """1 / (k + 1 + rank), 0 where there is no rank."""
    return F.coalesce(1.0 / (F.lit(k + 1.0) + rank), F.lit(0.0))


def rrf(sparse: Column, dense: Column, entity: Column) -> Column:
    return W_SPARSE * reciprocal(sparse) + W_DENSE * reciprocal(dense) + W_ENTITY * reciprocal(entity)


def prior(popularity: Column, weight: float = PRIOR_WEIGHT) -> Column:
    return F.lit(weight) * F.least(F.log1p(popularity.cast("double")) / POPULARITY_LOG, F.lit(1.0))


def merge_lists(lists: list[tuple[DataFrame, str]]) -> DataFrame:
    """Candidates of several ranked lists: one row per (query_id, pid) with a rank column for each list, null where it is not in it.

    A union and one aggregation instead of a chain of full joins.
    """
    parts = None
    for df, name in lists:
        row = df.select("query_id", "pid", *[(F.col("rank") if n == name else F.lit(None).cast("long")).alias(n) for _, n in lists])
        parts = row if parts is None else parts.unionByName(row)
    return parts.groupBy("query_id", "pid").agg(*[F.min(n).alias(n) for _, n in lists])


def candidates(sparse: DataFrame, dense: DataFrame | None, entity: DataFrame | None, packs: DataFrame) -> DataFrame:
    """Candidate rows (record_id, pack, passage_id, s, d, e) of ranked lists (query_id, pid, score_micro, rank from 1), for the learned score.

    ``packs`` has the pack of each pid. s and d are structs of the rank, the rank among the pack's candidates (both from 0) and the score; e is
    the rank of the entity list. A candidate that a list lacks has null there.
    """
    kinds = [(df, n) for df, n in ((sparse, "s"), (dense, "d"), (entity, "e")) if df is not None]
    parts = None
    for df, name in kinds:
        place = F.struct((F.col("rank") - 1).cast("int").alias("rank"), (F.col("score_micro") / 1e6 if name != "e" else F.lit(0.0)).alias("score"))
        row = df.select("query_id", "pid", *[(place if n == name else F.lit(None).cast("struct<rank:int,score:double>")).alias(n) for n in ("s", "d", "e")])
        parts = row if parts is None else parts.unionByName(row)
    rows = parts.groupBy("query_id", "pid").agg(*[F.min(n).alias(n) for n in ("s", "d", "e")]).join(packs, "pid")

    def within(name: str) -> Column:
        place = F.row_number().over(Window.partitionBy("query_id", "pack").orderBy(F.col(f"{name}.rank").asc_nulls_last(), "pid")) - 1
        return F.when(F.col(name).isNotNull(), F.struct(F.col(f"{name}.rank").alias("rank"), place.cast("int").alias("prank"), F.col(f"{name}.score").alias("score"))).alias(name)

    return rows.select(F.col("query_id").alias("record_id"), "pack", F.col("pid").alias("passage_id"), within("s"), within("d"), F.col("e.rank").alias("e"))


def context(cand: DataFrame) -> DataFrame:
    """Per record and pack: top, mean and population deviation of both lists, and the packs' share of the best 50; with the record's tops."""
    by = Window.partitionBy("record_id")
    pack = cand.groupBy("record_id", "pack").agg(
        *[f(F.col(f"{x}.score")).alias(f"{x}_{n}") for x in ("s", "d") for n, f in (("ptop", F.max), ("mean", F.avg), ("sd", F.stddev_pop))],
        *[F.count_if(F.col(f"{x}.rank") < 50).alias(f"{x}_best") for x in ("s", "d")],
    )
    tops = [F.max(f"{x}_ptop").over(by).alias(f"{x}_top") for x in ("s", "d")]
    share = [(F.col(f"{x}_best") / F.greatest(F.sum(f"{x}_best").over(by), F.lit(1))).alias(f"{x}_share") for x in ("s", "d")]
    return pack.select("*", *tops, *share)


# The features of a candidate that are known before its passage is loaded, by the names and in the order that weight files have.
CHEAP = "rrf s_in s_rr60 s_rr5 s_lr s_prr5 s_plr s_pnorm s_gnorm d_in d_rr60 d_rr5 d_lr d_prr5 d_plr d_norm both e_in e_rr kw_only s_share d_share pack_size s_rr60_share d_pnorm s_pz d_pz s_ptop d_ptop q_len s_top d_top s_rr60_qlen d_rr60_qlen".split()


def cheap_features(cand: DataFrame, query_words: Column, pack_passages: Column, keyword_only: Column) -> DataFrame:
    """``cand`` joined with its context, with one double column for each of CHEAP. Ratios are 0 where the divisor is not positive."""
    ctx = context(cand)
    j = cand.join(ctx, ["record_id", "pack"])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    def log_rank(r: Column) -> Column:
        return F.log1p(F.coalesce(r, F.lit(MISSING_RANK)).cast("double"))

    def z(x: str) -> Column:
        v = (F.col(f"{x}.score") - F.col(f"{x}_mean")) / F.col(f"{x}_sd")
        return F.when(F.col(f"{x}.score").isNull(), -3.0).when(F.col(f"{x}_sd") > 0, F.least(F.lit(5.0), F.greatest(F.lit(-3.0), v))).otherwise(0.0)

    s, d, e = F.col("s.rank"), F.col("d.rank"), F.col("e")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    in_s, in_d = s.isNotNull(), d.isNotNull()
    q_len = F.log1p(query_words.cast("double"))
    value = {
        "rrf": rrf(s, d, e) * 100, "s_in": flag(in_s), "s_rr60": reciprocal(s), "s_rr5": reciprocal(s, 5.0), "s_lr": log_rank(s), "s_prr5": reciprocal(F.col("s.prank"), 5.0), "s_plr": log_rank(F.col("s.prank")),
        "s_pnorm": F.when(in_s, ratio(F.col("s.score"), F.col("s_ptop"))).otherwise(0.0), "s_gnorm": F.when(in_s, ratio(F.col("s.score"), F.col("s_top"))).otherwise(0.0),
        "d_in": flag(in_d), "d_rr60": reciprocal(d), "d_rr5": reciprocal(d, 5.0), "d_lr": log_rank(d), "d_prr5": reciprocal(F.col("d.prank"), 5.0), "d_plr": log_rank(F.col("d.prank")),
        "d_norm": F.when(in_d, ratio(F.col("d.score"), F.col("d_top"))).otherwise(0.0), "both": flag(in_s & in_d), "e_in": flag(e.isNotNull()), "e_rr": F.coalesce(1.0 / (1.0 + e), F.lit(0.0)), "kw_only": flag(keyword_only),
        "s_share": F.col("s_share"), "d_share": F.col("d_share"), "pack_size": F.log1p(pack_passages.cast("double")) / POPULARITY_LOG, "s_rr60_share": reciprocal(s) * F.col("s_share"),
        "d_pnorm": F.when(in_d, ratio(F.col("d.score"), F.col("d_ptop"))).otherwise(0.0), "s_pz": z("s"), "d_pz": z("d"), "s_ptop": F.coalesce(ratio(F.col("s_ptop"), F.col("s_top")), F.lit(0.0)), "d_ptop": F.coalesce(ratio(F.col("d_ptop"), F.col("d_top")), F.lit(0.0)),
        "q_len": q_len, "s_top": F.log1p(F.greatest(F.coalesce(F.col("s_top"), F.lit(0.0)), F.lit(0.0))), "d_top": F.coalesce(F.col("d_top"), F.lit(0.0)), "s_rr60_qlen": reciprocal(s) * q_len, "d_rr60_qlen": reciprocal(d) * q_len,
    }
    return j.select(*[F.col(c) for c in cand.columns], *[value[n].alias(f"f_{n}") for n in CHEAP])


def loaded_features(popularity: Column, ordinal: Column, text: Column, section: Column) -> list[Column]:
    """Popularity, lead flag, log ordinal, log length, has a section."""
    return [
        F.least(F.log1p(popularity.cast("double")) / POPULARITY_LOG, F.lit(1.0)).alias("l_pop"),
        F.when(ordinal == 0, 1.0).otherwise(0.0).alias("l_lead"),
        F.log1p(ordinal.cast("double")).alias("l_ord"),
        F.log1p(F.length(text).cast("double")).alias("l_len"),
        F.when(F.coalesce(section, F.lit("")) != "", 1.0).otherwise(0.0).alias("l_section"),
    ]


def learned_score(features: list[Column], linear: list[float], hidden: list[list[float]], hidden_bias: list[float], out: list[float]) -> Column:
    """A linear part plus one tanh layer; the weights are a small fixed model."""
    if any(len(row) != len(features) for row in [linear, *hidden]):
        raise ValueError("weights do not fit the features")
    total = sum((f * w for f, w in zip(features, linear)), F.lit(0.0))
    for row, b, o in zip(hidden, hidden_bias, out):
        total = total + F.lit(o) * F.tanh(sum((f * w for f, w in zip(features, row)), F.lit(b)))
    return total


def near_top(cand: DataFrame, score: Column, by: list[str], depth: int = DEPTH, pack_depth: int = PACK_DEPTH) -> DataFrame:
    """Candidates near the top of any list: by score, by a list's rank, by a pack's rank, or linked."""
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "pack", "passage_id")) - 1
    keep = (F.col("_pos") < depth) | (F.col("s.rank") < depth) | (F.col("d.rank") < depth) | (F.col("s.prank") < pack_depth) | (F.col("d.prank") < pack_depth) | F.col("e").isNotNull()
    return cand.withColumn("_pos", pos).where(F.coalesce(keep, F.lit(False))).drop("_pos")


def fused_pool(hits: DataFrame, score: str, by: list[str], article: list[str], ties: list[str], keep: int = FUSE_KEEP, per_article: int = PER_ARTICLE, pinned: str | None = None) -> DataFrame:
    """The pool of each query: best 3 × keep (and pinned rows), at most ``per_article`` of an article, cut to ``keep`` but for pinned rows.

    ``pool_rank`` counts from 0; ``rank_score`` is 1 / (60 + rank + 1), which lets pools of several queries be merged.
    """
    pin = F.coalesce(F.col(pinned), F.lit(False)) if pinned else F.lit(False)
    order = [F.desc(score), *ties]
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    wide = hits.withColumn("_first", first).where((F.col("_first") <= 3 * keep) | pin)
    capped = wide.withColumn("_in_article", F.row_number().over(Window.partitionBy(*by, *article).orderBy(*order))).where(F.col("_in_article") <= per_article)
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    cut = capped.withColumn("_pos", pos).where((F.col("_pos") <= keep) | pin)
    return cut.withColumn("pool_rank", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long")).withColumn("rank_score", 1.0 / (RRF_K + F.col("pool_rank") + 1)).drop("_first", "_in_article", "_pos")


def select_diverse(hits: DataFrame, score: str, by: list[str], article: list[str], ties: list[str], n: int, per_article: int, must: str | None = None) -> DataFrame:
    """Up to ``n`` hits, at most ``per_article`` of an article; the best hit of each ``must`` article comes first (pick_rank from 1)."""
    order = [F.desc(score), *ties]
    rows = hits.withColumn("_in", F.row_number().over(Window.partitionBy(*by, *article).orderBy(*order)))
    m = (F.coalesce(F.col(must), F.lit(False)) if must else F.lit(False)) & (F.col("_in") == 1)
    rows = rows.withColumn("_must", m).where((F.col("_in") <= per_article) | F.col("_must"))
    pick = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col("_must").cast("int")), *order))
    return rows.withColumn("pick_rank", pick.cast("long")).where(F.col("pick_rank") <= n).drop("_in", "_must")


def merge_pools(pools: DataFrame, by: list[str], key: list[str], order: str, score: str, keep: int = 2 * FUSE_KEEP) -> DataFrame:
    """Pools of several searches of one question: the first search that found a hit keeps it, then the best ``keep`` by score."""
    first = F.row_number().over(Window.partitionBy(*by, *key).orderBy(order))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *key))
    return pools.withColumn("_f", first).where("_f = 1").withColumn("merged_rank", rank.cast("long")).where(F.col("merged_rank") <= keep).drop("_f")


def list_penalty(title: Column) -> Column:
    """0.5 for list-like titles, which mention everything in passing."""
    t = F.lower(title)
    return F.when(t.rlike(r"^(list of |lists of |timeline of |glossary of |outline of |index of )") | t.rlike(r"^\d{4} in "), 0.5).otherwise(0.0)


def pack_penalty(pack: Column) -> Column:
    return F.when(pack.startswith("wikiquote"), 0.5).otherwise(0.0)


def rank_blend(by: list[str], order: list[Column], blend: float) -> Column:
    """blend × (1 − position / n), position from 0."""
    n = F.count("*").over(Window.partitionBy(*by))
    return F.lit(blend) * (1 - (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / n)
