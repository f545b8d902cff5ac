"""Picks and filters around retrieval: cards, fresh hits, teacher subsets, splits, gold pages, training questions, agreement."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernwerk.functions.dates import time_text
from kernwerk.functions.prose import select_pieces, token_cost
from kernwerk.functions.text import coordinates, numbers, url_page
from kernwerk.session import cut_lineage, replicated, salted


def gap_cut(hits: DataFrame, by: list[str], score: str, ties: list[str], gap: float, keep: int = 3) -> DataFrame:
    """The first ``keep`` hits of a question, then those whose score is within ``gap`` of its best."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties))
    best = F.max(score).over(Window.partitionBy(*by))
    return hits.withColumn("_p", place).withColumn("_b", best).where((F.col("_p") <= keep) | (F.col(score) >= F.col("_b") - gap)).drop("_p", "_b")


def article_scores(hits: DataFrame, by: list[str], article: list[str], score: str, ties: list[str]) -> DataFrame:
    """The score of each article: its best hit, and half of every further one."""
    n = F.row_number().over(Window.partitionBy(*by, *article).orderBy(F.desc(score), *ties))
    return hits.withColumn("_n", n).groupBy(*by, *article).agg(F.sum(F.when(F.col("_n") == 1, F.col(score)).otherwise(F.col(score) * 0.5)).alias("article_score"))


def card(hits: DataFrame, by: list[str], article: list[str], score: str, ties: list[str], named: str) -> DataFrame:
    """The hit shown on a question's card: the best hit of the named entity's article, else of the article with the highest score sum."""
    sums = article_scores(hits, by, article, score, ties)
    order = [F.desc(F.col(named).cast("int")), F.desc("article_score"), *article, F.desc(score), *ties]
    return hits.join(sums, [*by, *article]).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def fresh_first(hits: DataFrame, shown: DataFrame, by: list[str], key: list[str], score: str, n: int) -> DataFrame:
    """The n best hits, those not shown in the last turn before those shown; ``place`` from 1."""
    seen = shown.select(*by, *key).distinct().withColumn("_shown", F.lit(1))
    rows = hits.join(seen, [*by, *key], "left").withColumn("_shown", F.coalesce("_shown", F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_shown", F.desc(score), *key))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= n).drop("_shown")


def teacher_scores(hits: DataFrame, by: list[str], score: str, ties: list[str], n: int = 48) -> DataFrame:
    """Teacher scores for training: those of the best n by the current score; the rest get the smallest of them less 100."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties))
    rows = hits.withColumn("_p", place)
    low = F.min(F.when(F.col("_p") <= n, F.col("teacher"))).over(Window.partitionBy(*by))
    return rows.withColumn("teacher", F.when(F.col("_p") <= n, F.col("teacher")).otherwise(low - 100)).drop("_p")


def holdout(rows: DataFrame, key: str, percent: int = 20, seed: str = "0") -> DataFrame:
    """``held`` for about ``percent`` of the rows by a hash of the key: the same rows in every run and layout."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed))), 1, 7), 16, 10).cast("long")
    return rows.withColumn("held", h % 100 < percent)


def numbers_known(answer: Column, evidence: Column) -> Column:
    """Whether every number of an answer is one of the evidence."""
    return F.size(F.array_except(numbers(answer), numbers(evidence))) == 0


def trainable(pools: DataFrame, by: str, pack: str, least: int = 4) -> DataFrame:
    """Pools for training: without forum hits, and with at least ``least`` hits left."""
    kept = pools.where(~F.col(pack).startswith("stackexchange"))
    enough = kept.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(by)
    return kept.join(enough, by, "left_semi")


def training_questions(rows: DataFrame, source: str, key: str, text: str, held_out: DataFrame, n: int) -> DataFrame:
    """n questions of each source by hash: the first of repeated texts, none that equals a held-out question (one column, ``text``)."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Punct}]+", " ")))
    first = rows.withColumn("_k", norm(F.col(text))).withColumn("_f", F.row_number().over(Window.partitionBy("_k").orderBy(source, key))).where("_f = 1 and _k <> ''")
    free = first.join(held_out.select(norm(F.col("text")).alias("_k")).distinct(), "_k", "left_anti")
    pick = F.row_number().over(Window.partitionBy(source).orderBy(F.md5(F.col(key).cast("string")), key))
    return free.withColumn("_p", pick).where(F.col("_p") <= n).drop("_k", "_f", "_p")


def near_duplicates(rows: DataFrame, key: str, text: str, share: float = 0.6, salts: int = 8) -> DataFrame:
    """(a, b): pairs a < b of texts whose word sets overlap by ``share`` (Jaccard) or more. Words are runs of letters and digits of any script.

    Words are put in order of rarity. Two sets that overlap so much share one of the first n − ceil(share × n) + 1 words of both, so only
    rows that share such a rare word meet; function words are among these only in texts that have little else. A word that very many rows
    have still is spread over ``salts`` tasks. Texts of one word set are represented by the smallest key; texts without words have no pairs.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    sets = cut_lineage(rows.select(F.col(key).alias("k"), F.array_sort(words).alias("w")).where(F.size("w") > 0).groupBy("w").agg(F.min("k").alias("k")))
    each = sets.select("k", F.explode("w").alias("x"))
    df = each.groupBy("x").agg(F.count("*").alias("df"))
    ordered = each.join(df, "x").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("o"))  # a set of words: bounded by its text
    n = F.size("o")
    first = ordered.select("k", n.alias("n"), F.transform("o", lambda s: s["x"]).alias("w"), F.explode(F.slice(F.col("o"), F.lit(1), (n - F.ceil(F.lit(share) * n) + 1).cast("int"))).alias("f")).select("k", "n", "w", F.col("f.x").alias("x"))
    a, b = (first.select(F.col("k").alias(k), F.col("n").alias(f"n{k}"), F.col("w").alias(f"w{k}"), "x") for k in ("a", "b"))
    met = salted(a, "a", salts).join(replicated(b, salts), ["x", "_salt"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(share) * F.greatest("na", "nb")))
    both = F.size(F.array_intersect("wa", "wb"))
    return met.where(both >= F.lit(share) * (F.col("na") + F.col("nb") - both)).select("a", "b").distinct()


def replayed_cut(hits: DataFrame, by: str, teacher: str, score: str, ties: list[str], keeps: tuple[int, ...], n: int = 8) -> DataFrame:
    """(keep, recall, questions): the mean share of the teacher's best n hits that a pool cut to its first ``keep`` by score would hold."""
    top = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(teacher), *ties))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), *ties))
    best = hits.withColumn("_t", top).withColumn("_p", place).where(F.col("_t") <= n)
    per = best.groupBy(by).agg(*[F.avg((F.col("_p") <= k).cast("int")).alias(f"k{k}") for k in keeps])
    rows = per.select(F.explode(F.array(*[F.struct(F.lit(k).alias("keep"), F.col(f"k{k}").alias("r")) for k in keeps])).alias("x"))
    return rows.groupBy("x.keep").agg(F.avg("x.r").alias("recall"), F.count("*").alias("questions"))


def pool_recall(pools: DataFrame, by: str, teacher: str, in_pool: str, ties: list[str], n: int = 8) -> DataFrame:
    """The mean share of the teacher's best n hits that a pool holds."""
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(teacher), *ties))
    top = pools.withColumn("_b", best).where(F.col("_b") <= n).groupBy(by).agg(F.avg(F.col(in_pool).cast("int")).alias("share"))
    return top.agg(F.avg("share").alias("recall"), F.count("*").alias("questions"))


def gold_pages(urls: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, article_id) of the pages that gold URLs open: by title, else by redirect. ``titles`` has key, article_id, how."""
    page = urls.select("query_id", url_page(F.col("url")).alias("p")).where("p is not null")
    j = page.select("query_id", F.lower("p.title").alias("key")).join(titles, "key")
    pick = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("how", "article_id"))
    return j.withColumn("_p", pick).where("_p = 1").select("query_id", "article_id").distinct()


def typed_value(datatype: Column) -> tuple[Column, Column]:
    """(number, text) of a flat statement by its datatype; ``label`` is the label of an item value."""
    number = F.when(datatype == "quantity", F.col("amount"))
    text = (
        F.when(datatype == "quantity", F.lit(None).cast("string"))
        .when(datatype == "wikibase-item", F.col("label"))
        .when(datatype == "time", time_text(F.col("time"), F.col("prec")))
        .when(datatype == "globe-coordinate", coordinates(F.col("lat"), F.col("lon")))
        .when(datatype == "monolingualtext", F.when(F.col("language").isin("en", "mul"), F.col("text")))
        .otherwise(F.col("vstr"))
    )
    return number, text


def card_facts(facts: DataFrame, asked: DataFrame, per_entity: int = 3, bar: float = 0.10) -> DataFrame:
    """Facts of a question's entities: properties asked about first, then those all its entities share, then by priority; at most three each.

    ``facts`` has query_id, qid, pid, priority; ``asked`` has query_id, pid, relevance.
    """
    pairs = facts.select("query_id", "pid", "qid").distinct()
    shared = pairs.groupBy("query_id", "pid").agg(F.count("*").alias("_c")).join(pairs.groupBy("query_id").agg(F.countDistinct("qid").alias("_n")), "query_id")
    shared = shared.select("query_id", "pid", ((F.col("_c") == F.col("_n")) & (F.col("_n") > 1)).cast("int").alias("_shared"))
    rows = facts.join(shared, ["query_id", "pid"]).join(asked, ["query_id", "pid"], "left")
    hot = F.when(F.coalesce("relevance", F.lit(0.0)) >= bar, F.col("relevance")).otherwise(F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("query_id", "qid").orderBy(F.desc(hot), F.desc("_shared"), "priority", "pid"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= per_entity).select("query_id", "qid", "pid", "place")


def human_agreement(rows: DataFrame) -> DataFrame:
    """How often a score from 1 to 5 and a human yes or no agree: 3.5 or more is yes, 1.5 or less no, the rest undecided."""
    said = F.when(F.col("score") >= 3.5, "yes").when(F.col("score") <= 1.5, "no")
    return rows.withColumn("said", said).agg(F.count("said").alias("decided"), F.count_if(F.col("said") == F.col("human")).alias("agree"))


def import_answers(answers: DataFrame, questions: DataFrame, key: str = "id") -> DataFrame:
    """Answers of another system joined to the questions; an unknown id is an error when the rows are read."""
    j = answers.join(questions.select(key).distinct().withColumn("_ok", F.lit(True)), key, "left")
    return j.withColumn("_ok", F.when(F.col("_ok").isNull(), F.raise_error(F.concat(F.lit("unknown question "), F.col(key)))).otherwise(F.col("_ok"))).where("_ok").drop("_ok")


def sentence_targets(labels: Column, n_pieces: Column, helpful: float = 0.3) -> Column:
    """Per piece 1.0 if needed, ``helpful`` if helpful, else 0, from labels such as "2.1:needed" of one passage; the larger wins."""
    place = lambda x: F.split(F.split(x, ":")[0], r"\.")[1].cast("int")
    worth = lambda x: F.when(x.endswith(":needed"), 1.0).otherwise(helpful)
    return F.transform(F.sequence(F.lit(1), n_pieces), lambda i: F.aggregate(labels, F.lit(0.0), lambda acc, x: F.greatest(acc, F.when(place(x) == i, worth(x)).otherwise(0.0))))


def piece_coverage(questions: DataFrame, budgets: list[int], needed: float = 0.75) -> DataFrame:
    """(budget, n, needed_share, full_share, mean_tokens): what ``select_pieces`` gets of the needed pieces within each token budget.

    ``questions`` has pieces (array<array<string>>, a row for each hit), scores and targets of the same shape; a piece is needed if its
    target (``sentence_targets``) is over ``needed``. ``needed_share`` is over all needed pieces, ``full_share`` over the questions.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for hits, scores, targets in zip(part["pieces"], part["scores"], part["targets"]):
                need = {(i, j) for i, row in enumerate(targets) for j, v in enumerate(row) if v is not None and v > needed}
                for b in budgets:
                    got = select_pieces(hits, scores, b)
                    rows.append((b, len(need.intersection(got)), len(need), int(need.issubset(got)), sum(token_cost(hits[i][j]) for i, j in got)))
            yield pd.DataFrame(rows, columns=["budget", "got", "need", "whole", "tokens"])

    each = questions.select("pieces", "scores", "targets").mapInPandas(run, "budget long, got long, need long, whole long, tokens long")
    return each.groupBy("budget").agg(F.count("*").alias("n"), (F.sum("got") / F.greatest(F.sum("need"), F.lit(1))).alias("needed_share"), F.avg("whole").alias("full_share"), F.avg("tokens").alias("mean_tokens"))


def evidence_budget(lean: Column, warm: Column, context: Column) -> Column:
    """Tokens for evidence: 600, 450 when lean, 400 when warm; at most what the context leaves, at least 200."""
    want = F.when(warm, 400).when(lean, 450).otherwise(600)
    return F.greatest(F.lit(200), F.least(want, context))
