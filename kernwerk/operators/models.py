"""Model boundaries: encoders, pair scorers and generators as plug-ins with plain defaults; small heads and their training."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernwerk.functions.prose import term_list
from kernwerk.session import hash_sample


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class HashEncoder:
    """The default encoder: signed hashed terms, unit length. Deterministic, no model file."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        from zlib import crc32

        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in term_list(t or ""):
                h = crc32(w.encode())
                out[i, h % self.dims] += 1.0 if h >> 31 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class OverlapScorer:
    """The default pair scorer: shared terms over the terms of the query."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        q = set(term_list(query))
        return [len(q & set(term_list(t))) / max(1, len(q)) for t in texts]


class SilentGenerator:
    """The default generator answers nothing: evidence only."""

    def generate(self, prompt: str) -> str:
        return ""


def encode(df: DataFrame, text: str, out: str, make: Callable[[], Encoder] = HashEncoder, batch: int = 64, prefix: str = "", dims: int | None = None) -> DataFrame:
    """Adds vectors of a text column; the model is made once for each worker, batches go longest first within an Arrow batch. ``prefix`` stands
    before each text, as models want it for questions; of ``dims`` the first numbers stay, scaled to length 1 again."""
    from pyspark.sql.types import ArrayType, FloatType

    @F.pandas_udf(ArrayType(FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for p in parts:
            texts = [prefix + (t or "") for t in p.tolist()]
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
            got: list = [None] * len(texts)
            for b in range(0, len(order), batch):
                at = order[b : b + batch]
                for i, v in zip(at, model.encode([texts[i] for i in at])):
                    got[i] = v if dims is None else v[:dims] / (float(np.linalg.norm(v[:dims])) or 1.0)
            yield pd.Series(got)

    return df.withColumn(out, run(F.col(text)))


def rerank(hits: DataFrame, query: str, text: str, out: str = "rerank", make: Callable[[], PairScorer] = OverlapScorer) -> DataFrame:
    """Adds the pair score of a query and a text column: all texts of a query in an Arrow batch go to the model together, longest first."""
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in parts:
            queries, texts = [a or "" for a in q.tolist()], [b or "" for b in t.tolist()]
            groups: dict[str, list[int]] = {}
            for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
                groups.setdefault(queries[i], []).append(i)
            got = [0.0] * len(texts)
            for a, at in groups.items():
                for i, v in zip(at, model.score(a, [texts[i] for i in at])):
                    got[i] = float(v)
            yield pd.Series(got)

    return hits.withColumn(out, run(F.col(query), F.col(text)))


def gap_filter(score: Column, best: Column, place: Column, gap: float, keep: int = 3) -> Column:
    """The first ``keep`` hits, then those within ``gap`` of the best."""
    return (place <= keep) | (score >= best - gap)


def softmax_head(vector: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Class probabilities of a linear head, as an array; the weights are a small fixed model."""
    z = F.array(*[F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(w)) for w in row]), lambda a, b: a * b), F.lit(float(b)), lambda acc, x: acc + x) for row, b in zip(weights, bias)])
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def choose_label(probabilities: Column, labels: list[str], bars: dict[str, float], fallback: str) -> Column:
    """The most probable label; a label with a bar must reach it, else the fallback."""
    best = F.array_max(probabilities)
    name = F.get(F.array(*[F.lit(x) for x in labels]), F.array_position(probabilities, best).cast("int") - 1)
    bar = F.create_map(*[x for k, v in bars.items() for x in (F.lit(k), F.lit(float(v)))])[name] if bars else F.lit(None).cast("double")
    return F.when(bar.isNotNull() & (best < bar), F.lit(fallback)).otherwise(name)


def train_head(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch softmax regression on a bounded training matrix; weights and bias."""
    w, b = np.zeros((classes, x.shape[1])), np.zeros(classes)
    one = np.eye(classes)[y]
    for _ in range(rounds):
        z = x @ w.T + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - one) / len(x)
        w -= 1.0 * (g.T @ x + ridge * w)
        b -= 1.0 * g.sum(axis=0)
    return w, b


def label_bars(x: np.ndarray, y: np.ndarray, classes: int, strict: list[int], folds: int = 5) -> dict[int, float]:
    """For each strict class, the bar above the strongest held-out mistake, by cross-validation."""
    bars = dict.fromkeys(strict, 0.0)
    for f in range(folds):
        held = np.arange(len(x)) % folds == f
        w, b = train_head(x[~held], y[~held], classes)
        z = x[held] @ w.T + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for c in strict:
            wrong = (p.argmax(axis=1) == c) & (y[held] != c)
            if wrong.any():
                bars[c] = max(bars[c], float(p[wrong, c].max()))
    return bars


def train_fusion(x: np.ndarray, teacher: np.ndarray, groups: np.ndarray, rounds: int = 200, temperature: float = 1.0, ridge: float = 1e-3) -> np.ndarray:
    """Linear fusion weights by a listwise softmax against the teacher's best eight of each question, folded back to raw features."""
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z, w = (x - mean) / sd, np.zeros(x.shape[1])
    target = np.zeros(len(x))
    for g in np.unique(groups):
        at = np.flatnonzero(groups == g)
        best = at[np.argsort(-teacher[at], kind="stable")[:8]]
        e = np.exp((teacher[best] - teacher[best].max()) / temperature)
        target[best] = e / e.sum()
    for _ in range(rounds):
        s = z @ w
        p = np.zeros(len(x))
        for g in np.unique(groups):
            at = np.flatnonzero(groups == g)
            e = np.exp(s[at] - s[at].max())
            p[at] = e / e.sum()
        w -= 0.5 * (z.T @ (p - target) / len(np.unique(groups)) + ridge * w)
    return w / sd


def train_lists(vectors: DataFrame, column: str, lists: int, sample: int = 200_000, seed: int = 0):
    """Spherical k-means centroids of about ``sample`` rows at most, chosen by hash, in the cluster's machine learning library."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = hash_sample(vectors, [column], sample).select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    return KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=12).fit(rows).clusterCenters()


def mean_vectors(rows: DataFrame, owner: str, vector: str) -> DataFrame:
    """(owner, vector): the mean of an owner's vectors, scaled to unit length."""
    e = rows.select(owner, F.posexplode(vector).alias("d", "v")).groupBy(owner, "d").agg(F.avg("v").alias("v"))
    v = e.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x * x))
    return v.select(owner, F.transform("m", lambda x: x / F.when(norm > 0, norm).otherwise(1.0)).alias("vector"))


def erf(x: np.ndarray) -> np.ndarray:
    """The error function by a rational approximation, to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    y = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.sign(x) * y


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / np.sqrt(2)))


def layer_norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + eps) * gain + bias
