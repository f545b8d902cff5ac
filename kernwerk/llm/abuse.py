"""Abusive, hateful or sexual content by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, fsum
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kernwerk.functions.keys import spelling
from kernwerk.llm.voters import NAMES, POSITIVE, WEAK, passages, votes
from kernwerk.session import bounded_rows, cut_lineage, hash_sample

SAMPLE = 20_000  #: about so many passages of each kind (with and without votes) that the classifier is trained on; chosen by hash over the whole corpus
MAX_PATTERNS = 50_000
THRESHOLD = 0.5
LABELLED = 5.0  #: weight of a labelled passage beside a passage with a posterior label
SILENT = "." * len(NAMES)


#: What the accuracies are expected to be before any text is seen: patterns, single words, voters against.
EXPECTED = np.array([0.65 if n in WEAK else 0.85 for n in POSITIVE] + [0.95] * (len(NAMES) - len(POSITIVE)))
_SAME_SIDE = np.equal.outer(np.arange(len(NAMES)) < len(POSITIVE), np.arange(len(NAMES)) < len(POSITIVE))


@dataclass
class LabelModel:
    """The accuracy of each voter when it votes, and the correlations of voters of one side."""

    accuracy: np.ndarray
    together: np.ndarray

    def posterior(self, votes_: np.ndarray) -> np.ndarray:
        """P(abuse | votes): each vote counts the log-odds of its voter's accuracy, less where correlated voters speak too; silence says nothing."""
        odds = np.log(self.accuracy / (1 - self.accuracy)) / (1 + (votes_ != 0) @ self.together)
        return 1 / (1 + np.exp(-np.clip((votes_ * odds).sum(axis=1), -30, 30)))


def vote_matrix(patterns: list[str]) -> np.ndarray:
    return np.array([[{".": 0, "p": 1, "n": -1}[c] for c in p] for p in patterns], dtype=float).reshape(len(patterns), len(NAMES))


def fit_label_model(patterns: list[str], counts: np.ndarray, known: list[tuple[str, float]] = (), rounds: int = 40) -> LabelModel:
    """A generative model of votes: a true label, and voters that agree with it as often as their accuracy, given how they correlate.

    Expectation-maximisation over the vote patterns and their counts in the whole corpus. The expected accuracies weigh as much as what is
    seen of a voter. ``known`` are vote patterns of labelled texts: their labels stay fixed, and together they weigh as much as the corpus,
    however large it is, so that a group of voters that err together cannot turn the model round.
    """
    fixed = np.array([y for _, y in known], dtype=float)
    x = vote_matrix([*patterns, *(p for p, _ in known)])
    model = LabelModel(EXPECTED.copy(), np.zeros((len(NAMES), len(NAMES))))
    if not len(x):
        return model
    n = np.concatenate([counts.astype(float), np.full(len(fixed), (counts.sum() or 1.0) / max(1, len(fixed)))])
    n = n / n.sum()
    spoken = (x != 0).astype(float)
    mean = n @ spoken
    cov = (spoken * n[:, None]).T @ spoken - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    model.together = np.where(_SAME_SIDE, np.clip(cov / np.outer(sd, sd), 0, 1), 0)
    np.fill_diagonal(model.together, 0)
    for _ in range(rounds):
        q = model.posterior(x)
        q[len(patterns) :] = np.clip(fixed, 0.02, 0.98)
        agree = n @ np.where(x > 0, q[:, None], np.where(x < 0, 1 - q[:, None], 0))
        model.accuracy = np.clip((agree + mean * EXPECTED + 1e-6 * EXPECTED) / (2 * mean + 1e-6), 0.55, 0.99)
    return model


def features(passage: list[str], pattern: str | None) -> set[str]:
    out = set(passage)
    out.update(f"{a} {b}" for a, b in zip(passage, passage[1:]))
    if pattern:
        out.update(f"#{n}" for n, c in zip(NAMES, pattern) if c != ".")
        out.add(f"#for{min(3, pattern[: len(POSITIVE)].count('p'))}")
    return out


def fit_linear(rows: list[tuple[list[str], str | None]], labels: np.ndarray, weights: np.ndarray, least: int = 8, rounds: int = 600, ridge: float = 5e-5) -> tuple[float, dict[str, float]]:
    """Logistic regression on soft labels: votes, and words and word pairs that occur in at least ``least`` rows."""
    sets = [features(*r) for r in rows]
    seen: dict[str, int] = {}
    for s in sets:
        for f in s:
            seen[f] = seen.get(f, 0) + 1
    place = {f: i for i, f in enumerate(sorted(f for f, k in seen.items() if k >= least or f[0] == "#"))}
    row_of = np.repeat(np.arange(len(sets)), [sum(f in place for f in s) for s in sets])
    col_of = np.array([place[f] for s in sets for f in sorted(s) if f in place], dtype=np.int64)
    w, bias = np.zeros(len(place)), 0.0
    g2, b2 = np.full(len(place), 1e-8), 1e-8
    total = weights.sum()
    for _ in range(rounds):
        z = bias + np.bincount(row_of, weights=w[col_of], minlength=len(sets))
        error = weights * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / total
        g = np.bincount(col_of, weights=error[row_of], minlength=len(place)) + ridge * w
        g2 += g * g
        b2 += error.sum() ** 2
        w -= 0.5 * g / np.sqrt(g2)
        bias -= 0.5 * error.sum() / np.sqrt(b2)
    return bias, {f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-3}


class Classifier:
    """Scores passages; what the workers get of the trained model."""

    def __init__(self, bias: float, weight: dict[str, float]) -> None:
        self.bias = bias
        self.word = {f: w for f, w in weight.items() if " " not in f}
        self.pair = {tuple(f.split(" ")): w for f, w in weight.items() if " " in f}
        self.words, self.pairs = frozenset(self.word), frozenset(self.pair)
        self.firsts = frozenset(a for a, _ in self.pair)

    def score(self, passage: list[str], pattern: str | None) -> float:
        """The probability of abuse; the exact sum makes it independent of the order of words in a set."""
        parts = [self.word[f] for f in self.words.intersection(passage)]
        if not self.firsts.isdisjoint(passage):
            parts += [self.pair[p] for p in self.pairs.intersection(zip(passage, passage[1:]))]
        if pattern:
            parts += [self.word.get(f"#{n}", 0.0) for n, c in zip(NAMES, pattern) if c != "."]
            parts.append(self.word.get(f"#for{min(3, pattern[: len(POSITIVE)].count('p'))}", 0.0))
        z = self.bias + fsum(parts)
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))

    def best(self, text: str | None) -> float:
        return max((self.score(p, votes(p)) for p in passages(text)), default=0.0)


class Smallest:
    """The passages of one kind with the smallest hashes, each once: at most ``size``, whatever the number that comes."""

    def __init__(self, size: int) -> None:
        self.size, self.bound = size, 1 << 32
        self.rows: dict[tuple[int, str], str] = {}

    def add(self, words: list[str], pattern: str) -> None:
        joined = " ".join(words)
        h = crc32(joined.encode("utf-8", "replace"))
        if h < self.bound:
            self.rows[h, joined] = pattern
            if len(self.rows) > 2 * self.size:
                kept = sorted(self.rows)[: self.size]
                self.bound = kept[-1][0] + 1
                self.rows = {k: self.rows[k] for k in kept}


def vote_counts(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(pattern, n, hash, passage): the vote patterns of all passages with their numbers, and of each task the voted and the silent passages of
    the smallest hashes (n is null), at most ``sample`` each. The other texts never leave their task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        voted, silent = Smallest(sample), Smallest(sample)
        for part in parts:
            for t in part[text].tolist():
                for p in passages(t):
                    v = votes(p) or SILENT
                    counts[v] = counts.get(v, 0) + 1
                    (silent if v == SILENT else voted).add(p, v)
        rows = [(v, n, None, None) for v, n in counts.items()] + [(v, None, h, p) for kind in (voted, silent) for (h, p), v in sorted(kind.rows.items())[:sample]]
        columns = zip(("pattern", "n", "hash", "passage"), ("object", "Int64", "Int64", "object"))
        yield pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype=kind) for i, (name, kind) in enumerate(columns)})

    return docs.select(text).mapInPandas(run, "pattern string, n long, hash long, passage string")


def smallest_of_all(sampled: DataFrame, size: int, what: str) -> list:
    """About the ``size`` rows of the smallest hashes: a histogram over the hash tells where to cut, so only these reach the driver."""
    steps = 4096
    step = F.floor(F.col("hash") / ((1 << 32) // steps)).cast("int")
    bins = sorted((r["bin"], r["n"]) for r in bounded_rows(sampled.groupBy(step.alias("bin")).agg(F.countDistinct("hash").alias("n")), steps, "steps of the hash"))
    total, last = 0, -1
    for b, n in bins:
        if total + n > size and total:
            break
        total, last = total + n, b
    return bounded_rows(sampled.where(step <= last).select("pattern", "passage").distinct(), 2 * size + 1000, what)


def train(docs: DataFrame, samples: DataFrame, sample: int = SAMPLE) -> tuple[Classifier, LabelModel]:
    """Fit both models. Counts of vote patterns come from all passages of all documents; the classifier sees about ``sample`` voted and
    ``sample`` silent passages at most, those of the smallest hashes, and the labelled samples, chosen likewise."""
    got = cut_lineage(vote_counts(docs.where(F.length("text") > 0), sample=sample))
    patterns = bounded_rows(got.where(F.col("n").isNotNull()).groupBy("pattern").agg(F.sum("n").alias("n")), MAX_PATTERNS, "vote patterns")
    names = [r["pattern"] for r in patterns]
    counts = np.array([r["n"] for r in patterns], dtype=float)
    labelled: list[tuple[list[str], str | None, float]] = []
    known = bounded_rows(hash_sample(samples.where(F.col("text").isNotNull() & F.col("category").isNotNull()).select("text", "category").distinct(), ["text", "category"], sample), 2 * sample, "labelled texts")
    for r in sorted(known, key=lambda r: (r["text"], r["category"])):
        parts = [(p, votes(p)) for p in passages(r["text"])]
        if r["category"] != "none":  # the passage that draws most votes carries the label of its text
            parts = sorted(parts, key=lambda p: -(p[1] or "").count("p"))[:1]
        labelled += [(p, v, float(r["category"] != "none")) for p, v in parts]
    order = [i for i in np.argsort(names) if names[i] != SILENT]
    names = [names[i] for i in order]
    model = fit_label_model(names, counts[order], [(v, y) for _, v, y in labelled if v])
    posterior = dict(zip(names, model.posterior(vote_matrix(names)))) if names else {}
    kind = lambda silent: got.where(((F.col("pattern") == SILENT) == silent) & F.col("passage").isNotNull())
    some = [r for silent in (False, True) for r in smallest_of_all(kind(silent), sample, "sampled passages")]
    some.sort(key=lambda r: (r["pattern"], r["passage"]))
    rows: list[tuple[list[str], str | None]] = []
    labels: list[float] = []
    weights: list[float] = []
    for r in some:
        silent = r["pattern"] == SILENT
        rows.append((r["passage"].split(" "), None if silent else r["pattern"]))
        labels.append(0.0 if silent else posterior[r["pattern"]])
        weights.append(1.0)
    for p, v, y in labelled:  # a few labels are wrong: one that all votes contradict counts little
        q = float(model.posterior(vote_matrix([v]))[0]) if v else 0.05
        rows.append((p, v))
        labels.append(y)
        weights.append(0.1 if (y == 1 and not v) or (y == 0 and q > 0.75) else LABELLED)
    if not rows:
        return Classifier(-4.0, {}), model
    return Classifier(*fit_linear(rows, np.array(labels), np.array(weights))), model


def score_documents(docs: DataFrame, classifier: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of the worst passage of each whole text; null and empty texts score 0. A map: nothing is shuffled."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # at most a few features for each row of the bounded training sample

    at = docs.columns.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for p in parts:
            got = pa.array([c.best(t) for t in p.column(at).to_pylist()], type=pa.float64())
            yield pa.RecordBatch.from_arrays([*p.columns, got], names=[*p.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))  # as a column function, the optimizer would move it before a repartitioning


def scored(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, source, score): train on the corpus and the samples, then score every document."""
    classifier, _ = train(docs, samples)
    return score_documents(docs.select("doc_id", "source", "text"), classifier).select("doc_id", spelling(F.col("source")).alias("source"), "score")


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_docs, n_flagged, rate) by the uniform spelling of the source; null and blank sources are one group with a null source."""
    s = F.when(F.col("source") != "", F.col("source")).alias("source")
    return scores.groupBy(s).agg(F.count("*").alias("n_docs"), F.count_if(F.col("score") >= threshold).alias("n_flagged")).withColumn("rate", F.col("n_flagged") / F.col("n_docs"))
