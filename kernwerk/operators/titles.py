"""Titles, redirects and aliases: lookups, candidates, senses, linkable names, and entity mentions in questions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernwerk.functions.text import STOP_WORDS, normalize_title

MAX_CANDIDATES, MAX_SENSES, MAX_NGRAM, MAX_ENTITIES = 6, 12, 5, 3


def current_articles(articles: DataFrame) -> DataFrame:
    """One row per article id: the largest popularity of its rows, the latest title."""
    return articles.groupBy("article_id").agg(F.max_by("title", F.struct("added_at", "title")).alias("title"), F.max("popularity").alias("popularity"), F.max(F.coalesce("linkable", F.lit(True))).alias("linkable"), F.min("qid").alias("qid")).withColumn("key", F.when(F.col("linkable"), normalize_title(F.col("title"))).otherwise(""))


def redirect_keys(redirects: DataFrame) -> DataFrame:
    """(key, article_id): the first redirect of a key by load time wins."""
    r = redirects.where("article_id is not null").select(normalize_title(F.col("from_title")).alias("key"), "article_id", "loaded_at", "redirect_id")
    return r.groupBy("key").agg(F.min_by("article_id", F.struct("loaded_at", "redirect_id")).alias("article_id"))


def lookup(names: DataFrame, articles: DataFrame, redirects: DataFrame) -> DataFrame:
    """(name, article_id, how): the article of a name: its title, else a redirect; the more popular article, then the smaller id."""
    asked = names.select("name", normalize_title(F.col("name")).alias("key")).distinct()
    direct = asked.join(articles.where("key <> ''"), "key").select("name", "article_id", "popularity", F.lit(0).alias("how"))
    other = asked.join(redirect_keys(redirects), "key").join(articles.select("article_id", "popularity"), "article_id").select("name", "article_id", "popularity", F.lit(1).alias("how"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("how", F.desc("popularity"), "article_id"))
    return direct.unionByName(other).withColumn("_r", rank).where("_r = 1").select("name", "article_id", "how")


def prefix_candidates(names: DataFrame, articles: DataFrame, n: int = MAX_CANDIDATES) -> DataFrame:
    """Articles whose title is the name or starts with it and a space. Titles are exploded into their word prefixes, so the join is an equi-join."""
    words = F.split("key", " ")
    prefixes = articles.where("key <> ''").select("article_id", "popularity", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), " "))).alias("key"))
    asked = names.select("name", normalize_title(F.col("name")).alias("key")).distinct()
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("popularity"), "article_id"))
    return asked.join(prefixes, "key").withColumn("place", rank.cast("long")).where(F.col("place") <= n).select("name", "article_id", "place")


def senses(names: DataFrame, articles: DataFrame, n: int = MAX_SENSES) -> DataFrame:
    """Articles titled with the name alone, or with the name and a bracketed qualifier."""
    base = articles.where("key <> ''").withColumn("base", F.regexp_extract("key", r"^(.*?)(?: \(.*)?$", 1))
    asked = names.select("name", normalize_title(F.col("name")).alias("base")).distinct()
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("popularity"), "article_id"))
    return asked.join(base, "base").withColumn("place", rank.cast("long")).where(F.col("place") <= n).select("name", "article_id", "place")


def codes(redirects: DataFrame) -> DataFrame:
    """(code, article_id): redirects from two to five capitals, looked up with their case."""
    return redirects.where(F.col("from_title").rlike("^[A-Z]{2,5}$") & F.col("article_id").isNotNull()).groupBy(F.col("from_title").alias("code")).agg(F.min_by("article_id", F.struct("loaded_at", "redirect_id")).alias("article_id"))


def safe_alias(c: Column) -> Column:
    """An alias that may link: several words, a code of capitals, or a capitalised word of four letters or more."""
    several = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) >= 2
    return (F.length(c) <= 80) & (several | c.rlike("^[A-Z]{2,5}$") | c.rlike("^[A-Z].{3,}$"))


def linkable(title: Column, lead: Column) -> Column:
    head = F.substring(F.coalesce(lead, F.lit("")), 1, 400)
    return ~(title.contains("(disambiguation)") | head.contains("may refer to") | head.contains("may also refer to"))


def skip_article(title: Column, text: Column) -> Column:
    return title.contains("(disambiguation)") | title.startswith("List of") | F.substring(text, 1, 300).contains("may refer to")


def alias_redirects(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """(key, article_id): labels and aliases of entities as redirects to their article: safe ones that shadow no title; the most popular article wins."""
    names = entities.select("qid", F.explode(F.concat(F.array("label"), F.split(F.coalesce("aliases", F.lit("")), r"\|"))).alias("name")).where("name is not null and name <> ''")
    rows = names.where(safe_alias(F.col("name"))).select("qid", normalize_title(F.col("name")).alias("key")).distinct().join(articles.select("qid", "article_id", "popularity"), "qid")
    free = rows.join(articles.where("key <> ''").select("key"), "key", "left_anti")
    return free.groupBy("key").agg(F.min_by("article_id", F.struct(-F.col("popularity"), F.col("article_id"))).alias("article_id"))


def ngrams(queries: DataFrame, longest: int = MAX_NGRAM) -> DataFrame:
    """(query_id, start, n, name): all runs of one to ``longest`` words that do not begin or end in a function word."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    w = F.filter(F.split("query", r"[\s?!,;:\"]+"), lambda x: x != "")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(i.alias("start"), n.alias("n"), F.slice("w", i, n).alias("p")))).otherwise(F.array().cast("array<struct<start:int,n:int,p:array<string>>>"))))
    ok = lambda s: ~F.array_contains(stop, F.lower(F.element_at(s["p"], 1))) & ~F.array_contains(stop, F.lower(F.element_at(s["p"], -1)))
    return queries.withColumn("w", w).select("query_id", F.explode(F.filter(spans, ok)).alias("s")).select("query_id", "s.start", "s.n", F.array_join("s.p", " ").alias("name"))


def link(queries: DataFrame, articles: DataFrame, redirects: DataFrame, most: int = MAX_ENTITIES) -> DataFrame:
    """(query_id, start, n, article_id): mentions of titles and redirects, longest first and without overlap, the ``most`` popular of each question."""
    grams = ngrams(queries)
    found = grams.join(lookup(grams.select("name").distinct(), articles, redirects), "name").join(articles.select("article_id", "popularity"), "article_id")

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        out, seen = [], set()
        for r in rows.sort_values(["n", "start", "article_id"], ascending=[False, True, True]).itertuples():
            span = range(r.start, r.start + r.n)
            if used.isdisjoint(span) and r.article_id not in seen:
                used.update(span)
                seen.add(r.article_id)
                out.append((r.query_id, r.start, r.n, r.article_id, r.popularity))
        got = pd.DataFrame(out, columns=["query_id", "start", "n", "article_id", "popularity"])
        return got.sort_values(["popularity", "article_id"], ascending=[False, True]).head(most)[["query_id", "start", "n", "article_id"]]

    return found.groupBy("query_id").applyInPandas(greedy, "query_id string, start int, n int, article_id long")
