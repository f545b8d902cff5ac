"""Nearest rows of a stated set of queries: blocks of queries against blocks of rows, each pair of blocks one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_QUERIES, BLOCK_ROWS = 2048, 65_536
NONE = -(1 << 62)


def block_top_k(queries: DataFrame, rows: DataFrame, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], vector: str = "vector", keep_self: bool = False, block_queries: int = BLOCK_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, score_micro, rank): the k rows with the highest score for each query; ties go to the smaller id.

    ``queries`` has query_id and the vector, ``rows`` has id and the vector. ``score`` maps two matrices to one. Blocks bound the memory of
    a task; each pair of blocks keeps only its own k best for each query before the last shuffle. A query is not its own neighbour.
    """
    nq, nr = queries.count(), rows.count()
    q_blocks, r_blocks = max(1, -(-nq // block_queries)), max(1, -(-nr // block_rows))
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = queries.select(F.col("query_id").alias("i"), F.col(vector).alias("v")).withColumn("qb", place("i", q_blocks)).withColumn("rb", all_(r_blocks))
    b = rows.select(F.col("id").alias("j"), F.col(vector).alias("w")).withColumn("rb", place("j", r_blocks)).withColumn("qb", all_(q_blocks))

    def search(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score_micro": pd.Series(dtype="int64")})
        y = y.sort_values("j", kind="stable")
        left, right = (np.stack([np.asarray(v) for v in s]) if not isinstance(s.iloc[0], bytes) else np.frombuffer(b"".join(s.tolist()), np.uint8).reshape(len(s), -1) for s in (x["v"], y["w"]))
        ids, out = y["j"].to_numpy(), []
        for begin in range(0, len(x), 256):
            s = np.floor(score(left[begin : begin + 256], right) * 1e6 + 0.5).astype(np.int64)
            me = x["i"].to_numpy()[begin : begin + 256]
            if not keep_self:
                s[me[:, None] == ids[None, :]] = NONE
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            got = np.take_along_axis(s, order, axis=1)
            ok = got > NONE
            out.append(pd.DataFrame({"query_id": np.repeat(me, ok.sum(axis=1)), "id": ids[order[ok]], "score_micro": got[ok]}))
        return pd.concat(out)

    best = a.groupBy("qb", "rb").cogroup(b.groupBy("qb", "rb")).applyInPandas(search, "query_id long, id long, score_micro long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score_micro"), "id"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.float64) @ b.astype(np.float64).T


def minus_hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minus the number of differing bits of packed codes."""
    x, y = (np.unpackbits(m, axis=1).astype(np.float32) * 2 - 1 for m in (a, b))
    return ((x @ y.T) - x.shape[1]).astype(np.float64) / 2


def asymmetric(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A float query against sign codes: the sum of q over set bits minus the sum over clear bits."""
    return a.astype(np.float64) @ (np.unpackbits(b, axis=1).astype(np.float64) * 2 - 1).T
