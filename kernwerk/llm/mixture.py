"""Mixing sources to target shares of tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from kernwerk.functions.keys import spelling
from kernwerk.llm.tokens import DEFAULT_PATH, VOCABULARY, contractor
from kernwerk.session import bounded_rows, cut_lineage, hash_sample

MAX_DOMAINS = 1000
SAMPLE = 20_000  #: about so many labelled documents train the domain classifier, chosen by hash over all of them
HASHES = 1 << 14
MODEL = 1 << 22  #: numbers of the classifier at most: with more domains words share hashes
ROUNDS = 12
LEAST_TOTAL = 0.25  #: the mixture has at least this part of the corpus' tokens, also where a source then misses its share
BINS = 4096
_WORD = re.compile(r"[^\W\d_]+|\d")


@dataclass
class Domains:
    names: list[str]
    weight: np.ndarray
    cap: np.ndarray


def read_targets(targets: DataFrame) -> Domains:
    """The target table: one row for each source by its uniform spelling, weights scaled to 1. At most MAX_DOMAINS rows, else an error."""
    rows = bounded_rows(targets.select(spelling(F.col("source")).alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("cap")).where((F.col("source") != "") & (F.col("weight") > 0)).groupBy("source").agg(F.max("weight").alias("weight"), F.max("cap").alias("cap")), MAX_DOMAINS, "targets")
    rows = sorted(rows, key=lambda r: r["source"])
    w = np.array([r["weight"] for r in rows], dtype=float)
    return Domains([r["source"] for r in rows], w / (w.sum() or 1.0), np.array([max(0, r["cap"] if r["cap"] is not None else 1) for r in rows], dtype=float))


def _hashes(text: str, size: int) -> np.ndarray:
    from zlib import crc32

    return np.unique(np.fromiter((crc32(w.encode("utf-8", "replace")) % size for w in _WORD.findall(text.lower())), dtype=np.int64))


class DomainClassifier:
    """Naive Bayes on the words of a document: P(domain | text), from the numbers of documents of each domain, with each hashed word and in all."""

    def __init__(self, seen: np.ndarray, total: np.ndarray) -> None:
        n, self.size = seen.shape
        p = (seen + 0.1) / (total[:, None] + 1.0)
        self.log_odds = (np.log(p) - np.log1p(-np.minimum(p, 0.999))).astype(np.float32)
        self.empty = np.log((total + 0.5) / (total.sum() + 0.5 * n))
        self.base = np.log1p(-np.minimum(p, 0.999)).sum(axis=1) + self.empty

    def posterior(self, text: str) -> np.ndarray:
        h = _hashes(text, self.size)
        z = self.base + self.log_odds[:, h].sum(axis=1) if len(h) else self.empty
        e = np.exp(z - z.max())
        return e / e.sum()


def fit_classifier(labelled: DataFrame, n: int, sample: int) -> DomainClassifier:
    """Counts of hashed words by domain (``_known``) over about ``sample`` documents chosen by hash; only the counts reach the driver, at most
    MODEL numbers, however long the texts are."""
    size = 1 << min(HASHES.bit_length() - 1, (MODEL // max(1, n)).bit_length() - 1)
    own = size  # a word of its own, in every document: the number of documents

    @F.pandas_udf(ArrayType(IntegerType()))
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [*_hashes(t, size).tolist(), own])

    words = hash_sample(labelled, ["doc_id"], sample).select(F.col("_known").alias("d"), F.explode(hashed("text")).alias("h")).groupBy("d", "h").agg(F.count("*").alias("n"))
    seen = np.zeros((n, size + 1))
    for r in bounded_rows(words, n * (size + 1), "hashed words"):
        seen[r["d"], r["h"]] = r["n"]
    return DomainClassifier(seen[:, :size], seen[:, own])


def memberships(docs: DataFrame, domains: Domains, sample: int = SAMPLE, tokenizers: str = DEFAULT_PATH, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, domain, n_tokens, p): tokens of each whole text, and the soft membership in each domain.

    A document that names a source of the table is of that domain; the classifier gives the posteriors of the others (null, blank and
    unlisted sources). ``domain`` is the most probable one. Null and empty texts have no tokens and drop out.
    """
    names = F.array(*[F.lit(n) for n in domains.names])
    rows = docs.select("doc_id", spelling(F.col("source")).alias("source"), "text").where(F.length("text") > 0)
    rows = rows.withColumn("_known", F.coalesce(F.array_position(names, F.col("source")).cast("int") - 1, F.lit(-1)))
    n = len(domains.names)
    model = docs.sparkSession.sparkContext.broadcast(fit_classifier(rows.where(F.col("_known") >= 0), n, sample))  # at most MODEL numbers
    path = f"{tokenizers}/{vocabulary}"

    @F.pandas_udf(StructType([StructField("n_tokens", IntegerType()), StructField("p", ArrayType(DoubleType()))]))
    def measured(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        c, m = contractor(path), model.value
        one = np.eye(n)
        for known, texts in parts:
            values, sizes = texts.tolist(), []
            for i in range(0, len(values), 2000):
                sizes += [len(x) for x in c.encode(values[i : i + 2000])]
            yield pd.DataFrame({"n_tokens": pd.Series(sizes, dtype="int32"), "p": [(one[k] if k >= 0 else np.round(m.posterior(t), 3)).tolist() for k, t in zip(known.tolist(), values)]})

    out = rows.withColumn("_m", measured("_known", "text"))
    p = F.col("_m.p")
    best = F.array_position(p, F.array_max(p)).cast("int") - 1
    return out.select("doc_id", "source", best.alias("domain"), (F.col("_known") >= 0).alias("known"), F.col("_m.n_tokens").cast("long").alias("n_tokens"), p.alias("p"))


def rate(steps: list[np.ndarray], domains: Domains) -> Column:
    """The rate of a document after the given gradient steps: it depends on its memberships and its cap only, so it is replayed, not stored."""
    caps, moves = domains.cap, np.array(steps).reshape(len(steps), len(domains.names))

    @F.pandas_udf(DoubleType())
    def replay(p: pd.Series, domain: pd.Series) -> pd.Series:
        if not len(p):
            return pd.Series([], dtype="float64")
        cap = caps[domain.to_numpy()]
        r = np.minimum(1.0, cap)
        for move in (np.stack(p.to_numpy()) @ moves.T).T:
            r = np.clip(r - move, 0.0, cap)
        return pd.Series(r)

    return replay(F.col("p"), F.col("domain"))


def fit_rates(members: DataFrame, domains: Domains, rounds: int = ROUNDS, least_total: float = LEAST_TOTAL) -> tuple[list[np.ndarray], np.ndarray]:
    """Projected gradient for min sum over domains of (expected tokens - target)² with 0 <= rate <= cap; (steps, target tokens).

    The rate depends on memberships and cap only, so documents of equal memberships are added up first; each round is one aggregation of
    these few rows to as many numbers as there are domains. A gradient is scaled by its domain's size,
    which makes the steps as sure for small domains as for large ones. The total is the largest at which every source that has documents
    can hold its share, at most the corpus and at least ``least_total`` of it. A source has documents if any names it, however few.
    """
    n = len(domains.names)
    members = cut_lineage(members.groupBy("p", "domain", "known").agg(F.sum("n_tokens").alias("n_tokens")))
    t = F.col("n_tokens")
    cap = F.array(*[F.lit(float(c)) for c in domains.cap])[F.col("domain")]
    got = members.agg(*[F.sum(t * F.col("p")[i]).alias(f"s{i}") for i in range(n)], *[F.sum(t * cap * F.col("p")[i]).alias(f"c{i}") for i in range(n)], F.sum(t).alias("all"), F.collect_set(F.when(F.col("known"), F.col("domain"))).alias("named")).first()
    size = np.array([float(got[f"s{i}"] or 0) for i in range(n)])
    most = np.array([float(got[f"c{i}"] or 0) for i in range(n)])
    corpus = float(got["all"] or 0)
    there = np.isin(np.arange(n), got["named"])  # a share of the corpus would pass over a small source
    bound = min([corpus, *(most[i] / domains.weight[i] for i in range(n) if there[i])])
    target = domains.weight * max(bound, least_total * corpus)
    steps: list[np.ndarray] = []
    for _ in range(rounds if corpus else 0):
        now = members.withColumn("_r", rate(steps, domains)).agg(*[F.sum(F.col("_r") * t * F.col("p")[i]).alias(f"s{i}") for i in range(n)]).first()
        error = np.array([float(now[i] or 0) for i in range(n)]) - np.minimum(target, most)  # beyond its cap a source would only draw the documents that resemble it
        steps.append(np.where(there, error / np.maximum(size, 1.0), 0.0))
        if np.abs(steps[-1]).max() < 1e-4:
            break
    return steps, target


def unit(id_col: str) -> Column:
    """A number in [0, 1) from an id, the same in every attempt."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(BINS * 4096)) / F.lit(float(BINS * 4096))


def mixture(docs: DataFrame, targets: DataFrame, tokenizers: str = DEFAULT_PATH) -> tuple[DataFrame, Domains, np.ndarray, DataFrame]:
    """(doc_id, source, domain, n_tokens, p, n_copies): how often each document is used, with the domains, target tokens and all members.

    A rate of 1.3 gives one copy, and a second one to documents with a small hash: for each domain a histogram of tokens over the hash tells
    where to stop, so that the domain's total is met and no document exceeds its cap.
    """
    domains = read_targets(targets)
    if not domains.names:
        empty = docs.select("doc_id", F.lit(None).cast("string").alias("source"), F.lit(-1).alias("domain"), F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<double>").alias("p"), F.lit(0).alias("n_copies")).where(F.lit(False))
        return empty, domains, np.zeros(0), empty
    members = cut_lineage(memberships(docs, domains, tokenizers=tokenizers))
    steps, target = fit_rates(members, domains)
    rated = members.withColumn("_r", rate(steps, domains)).withColumn("_u", unit("doc_id")).withColumn("_whole", F.floor(F.col("_r") + 1e-9)).withColumn("_part", F.greatest(F.col("_r") - F.col("_whole"), F.lit(0.0)))
    bins = rated.groupBy("domain", F.floor(F.col("_u") * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("_part")).alias("want"))
    stop: dict[int, float] = {}
    for d, rows in pd.DataFrame([r.asDict() for r in bounded_rows(bins, MAX_DOMAINS * BINS, "bins")], columns=["domain", "bin", "n", "want"]).groupby("domain"):
        rows = rows.sort_values("bin")
        sums = np.concatenate([[0.0], np.cumsum(rows["n"].to_numpy(dtype=float))])
        k = int(np.abs(sums - float(rows["want"].sum())).argmin())
        stop[int(d)] = 0.0 if k == 0 else (float(rows["bin"].iloc[k - 1]) + 1) / BINS
    limit = F.array(*[F.lit(stop.get(i, 0.0)) for i in range(len(domains.names))])[F.col("domain")]
    copies = (F.col("_whole") + F.when(F.col("_u") < limit, F.when(F.col("_part") > 1e-6, 1).otherwise(0)).otherwise(0)).cast("int")
    used = rated.select("doc_id", "source", "domain", "n_tokens", "p", copies.alias("n_copies"))
    return used.where(F.col("n_copies") > 0), domains, target, members


def shares(used: DataFrame, members: DataFrame, domains: Domains, target: np.ndarray) -> DataFrame:
    """(source, weight, share, n_tokens, expected_tokens, target_tokens, n_docs, n_copies, available_tokens, reached) for every source of the table.

    ``share`` is the part of the mixture's tokens, each document counted to its most probable source; ``expected_tokens`` splits it by its
    memberships, as the fit does. A source without documents, or with too few for its cap, has reached = false.
    """
    spark = used.sparkSession
    table = spark.createDataFrame([(i, n, float(w), float(t)) for i, (n, w, t) in enumerate(zip(domains.names, domains.weight, target))], "domain int, source string, weight double, target_tokens double")
    got = used.groupBy("domain").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("n_tokens"), F.count("*").alias("n_docs"), F.sum("n_copies").alias("n_copies"))
    soft = used.select(F.posexplode("p").alias("domain", "q"), (F.col("n_tokens") * F.col("n_copies")).alias("t")).where("q > 0").groupBy("domain").agg(F.sum(F.col("q") * F.col("t")).alias("expected_tokens"))
    have = members.groupBy("domain").agg(F.sum("n_tokens").alias("available_tokens"))
    total = used.agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("total"))
    rows = table.join(got, "domain", "left").join(soft, "domain", "left").join(have, "domain", "left").crossJoin(F.broadcast(total))  # one row
    tokens = F.coalesce("n_tokens", F.lit(0))
    return rows.select("source", "weight", F.coalesce(tokens / F.col("total"), F.lit(0.0)).alias("share"), tokens.alias("n_tokens"), F.coalesce("expected_tokens", F.lit(0.0)).alias("expected_tokens"), "target_tokens", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), (tokens >= 0.95 * F.col("target_tokens")).alias("reached"))
