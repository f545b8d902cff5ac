"""The question plan: many questions at once through retrieval, fusion, rerank, evidence, generation and citation check, as one DAG."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from kernwerk.functions import arithmetic
from kernwerk.functions.text import STEM, terms
from kernwerk.operators import evidence, fusion, models, passages, sparse
from kernwerk.session import cut_lineage


@dataclass
class Settings:
    sparse_k: int = 200
    fuse_keep: int = fusion.FUSE_KEEP
    rerank_keep: int = 8
    per_article: int = 3
    budget: int = 600
    rerank_blend: float = 0.0
    fields: dict = field(default_factory=lambda: {"title": "title", "section": "section_path", "body": "text"})


@F.pandas_udf(ArrayType(StringType()))
def stated_lines(questions: pd.Series) -> pd.Series:
    """What questions state to be computed: percentages and conversions."""
    return pd.Series([[x for x in (arithmetic.percent_line(q or ""), arithmetic.conversion_line(q or "")) if x] for q in questions.tolist()], dtype="object")


@dataclass(frozen=True)
class LearnedFusion:
    """A small fixed model over the cheap features: names of features, linear weights, one tanh layer."""

    features: tuple[str, ...]
    linear: list[float]
    hidden: list[list[float]] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    out: list[float] = field(default_factory=list)


class Library:
    """Passages (pid, article, title, section_path, text; popularity and pack where there are any) with their index; made once, asked often.

    The index is stored on first use, or given. ``dense`` and ``entities`` of ``pool`` are ranked lists (query_id, pid, score_micro, rank) that
    other searches made, such as ``dense.probe_topk`` and ``titles.link``; without them the plan is sparse.
    """

    def __init__(self, rows: DataFrame, settings: Settings | None = None, index: sparse.Index | None = None) -> None:
        self.rows, self.settings = rows, settings or Settings()
        self.index = index or sparse.store(rows, self.settings.fields)

    def pool(self, questions: DataFrame, dense: DataFrame | None = None, entities: DataFrame | None = None, model: LearnedFusion | None = None) -> DataFrame:
        """(query_id, query, pid, …, pool_rank): the fused pool of each question (query_id, query).

        A hit's score is the sum of the reciprocal ranks of its lists, the entity list counting double, and the prior of its popularity; or
        what the learned model says. Passages of linked entities stay in the pool.
        """
        s = self.settings
        found = sparse.bm25(self.index.postings, self.index.stats, questions, s.sparse_k)
        if model is not None:
            packs = self.rows.select("pid", (F.col("pack") if "pack" in self.rows.columns else F.lit("")).alias("pack"))
            sizes = packs.groupBy("pack").agg(F.count("*").alias("_size"))
            words = questions.select(F.col("query_id").alias("record_id"), F.size(F.split(F.trim("query"), r"\s+")).alias("_words"))
            rows = fusion.candidates(found, dense, entities, packs).join(words, "record_id").join(sizes, "pack")
            scored = fusion.cheap_features(rows, F.col("_words"), F.col("_size"), F.lit(False))
            score = fusion.learned_score([F.col(f"f_{n}") for n in model.features], model.linear, model.hidden, model.bias, model.out)
            hits = scored.select(F.col("record_id").alias("query_id"), F.col("passage_id").alias("pid"), F.floor(score * 1e6 + 0.5).alias("score"), F.col("e").isNotNull().alias("linked"))
        else:
            lists = [(df.withColumn("rank", F.col("rank").cast("long")), n) for df, n in ((found, "sparse"), (dense, "dense"), (entities, "entity")) if df is not None]
            merged = fusion.merge_lists(lists)
            weight = {"sparse": fusion.W_SPARSE, "dense": fusion.W_DENSE, "entity": fusion.W_ENTITY}
            hits = merged.withColumn("score", sum(weight[n] * fusion.reciprocal(F.col(n) - 1) for _, n in lists)).withColumn("linked", F.col("entity").isNotNull() if entities is not None else F.lit(False))
        loaded = hits.join(self.rows, "pid")
        if "popularity" in self.rows.columns and model is None:
            loaded = loaded.withColumn("score", F.col("score") + fusion.prior(F.col("popularity")))
        return fusion.fused_pool(loaded, "score", ["query_id"], ["article"], ["pid"], keep=s.fuse_keep, pinned="linked").join(questions, "query_id")

    def ranked(self, questions: DataFrame, make: Callable[[], models.PairScorer] = models.OverlapScorer, **lists) -> DataFrame:
        """The pool reranked, cut to diverse hits; ``rank`` from 1. ``lists`` are those of ``pool``."""
        s = self.settings
        scored = models.rerank(self.pool(questions, **lists), "query", "text", make=make)
        score = F.floor((F.col("rerank") - fusion.list_penalty(F.col("title"))) * 1e6 + 0.5)
        picked = fusion.select_diverse(scored.withColumn("final", score), "final", ["query_id"], ["article"], ["pool_rank"], s.rerank_keep, s.per_article)
        return picked.withColumn("rank", F.col("pick_rank"))

    def rarities(self, answers: DataFrame) -> DataFrame:
        """(query_id, rarity): for each answer the rarity of its terms in the library's bodies, as a map; a stem is as common as its commonest word."""
        asked = answers.select("query_id", F.explode(F.array_distinct(terms(F.col("answer")))).alias("term"))
        known = sparse.rarity(self.index.postings, self.rows).groupBy(F.substring("term", 1, STEM).alias("term")).agg(F.min("rarity").alias("r"))
        return asked.join(known, "term").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "r"))).alias("rarity"))

    def ask(self, questions: DataFrame, make_scorer: Callable[[], models.PairScorer] = models.OverlapScorer, make_generator: Callable[[], models.Generator] = models.SilentGenerator, facts: DataFrame | None = None, dated: str = "", **lists) -> DataFrame:
        """(query_id, evidence, answer, segments): the numbered evidence of each question, the generator's answer and its checked segments.

        ``facts`` (query_id, ord, entity, line) become sources after the passages; what the question itself states to be computed follows.
        """
        hits = self.ranked(questions, make_scorer, **lists)
        has = self.rows.columns
        hits = hits.select("query_id", "query", "rank", "pid", "title", F.col("section_path").alias("section"), (F.col("pack") if "pack" in has else F.lit("library")).alias("pack"), "text", (F.col("cards") if "cards" in has else F.lit(None).cast("array<string>")).alias("cards"))
        if facts is None:
            facts = questions.limit(0).select("query_id", F.lit(0).alias("ord"), F.lit("").alias("entity"), F.lit("").alias("line"))
        computed = questions.select("query_id", F.posexplode(stated_lines(F.col("query"))).alias("ord", "line"))
        shown = evidence.render(evidence.assemble(hits, facts, computed, self.settings.budget, dated), dated=dated).drop("query").join(questions, "query_id")

        @F.pandas_udf(StringType())
        def generate(query: pd.Series, text: pd.Series) -> pd.Series:
            g = make_generator()
            return pd.Series([g.generate(f"Question: {q}\n\nSources:\n{e}") for q, e in zip(query.tolist(), text.tolist())])

        out = cut_lineage(shown.withColumn("answer", generate("query", "evidence")))  # answered once, though the answers are read twice
        checked = out.join(self.rarities(out), "query_id", "left")
        return checked.select("query_id", "evidence", "answer", passages.supported_segments()(F.col("answer"), F.size("sources") + F.size("facts"), F.col("numbers"), F.col("evidence"), F.map_entries("rarity")).alias("segments"))
