"""Binary codes and inverted lists: packing, scoring, assignment, offsets, probing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

import numpy as np
import pandas as pd

from kernwerk.session import bounded_rows, small

NPROBE, PROBE_CODES, HAMMING_K, DENSE_K = 48, 48_000, 1000, 200
MAX_INDEXES = 1000
BLOCK_QUERIES, BLOCK_CODES = 1024, 16_384


@F.pandas_udf(BinaryType())
def pack_bits(vectors: pd.Series) -> pd.Series:
    """Sign bits, the first dimension at the highest bit of the first byte."""
    return pd.Series([np.packbits(np.asarray(v) > 0).tobytes() if v is not None else None for v in vectors])


def pack_words(vector: Column, dims: int) -> Column:
    """Sign bits as 32-bit words in an array<long>, in the JVM: bit d of word w is dimension 32 w + d from the left."""
    words = []
    for w in range(-(-dims // 32)):
        part = F.slice(vector, w * 32 + 1, 32)
        words.append(F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0)))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def lists_for(codes: Column, n_lists: Column, probe_codes: int = PROBE_CODES, nprobe: int = NPROBE) -> Column:
    """Lists that hold about ``probe_codes`` of an index: at least one, at most nprobe."""
    want = F.ceil(F.lit(float(probe_codes)) * n_lists / F.greatest(codes, F.lit(1)))
    return F.greatest(F.lit(1), F.least(want, F.lit(nprobe), n_lists)).cast("long")


def list_count(n: Column) -> Column:
    """A power of two near n / 1500, between 2^4 and 2^14."""
    return F.pow(F.lit(2.0), F.least(F.lit(14.0), F.greatest(F.lit(4.0), F.rint(F.log2(F.greatest(n, F.lit(1)) / 1500.0))))).cast("long")


def list_offsets(sizes: DataFrame) -> DataFrame:
    """(index_name, list_id, n, start, stop): where each list begins in an index stored in list order. One row a list; a window per index."""
    w = Window.partitionBy("index_name").orderBy("list_id")
    stop = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select("index_name", "list_id", "n", (stop - F.col("n")).alias("start"), stop.alias("stop"))


def list_sizes(index: DataFrame) -> DataFrame:
    return index.where("list_id is not null").select("index_name", "passage_id", "list_id").distinct().groupBy("index_name", "list_id").agg(F.count("*").alias("n"))


def code_alignment(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Differing bits between stored and newly made codes (id, words) of the same rows: smallest, median and largest."""
    d = stored.select("id", F.col("words").alias("a")).join(fresh.select("id", F.col("words").alias("b")), "id").select(hamming(F.col("a"), F.col("b")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.percentile("d", F.lit(0.5)).alias("median"), F.max("d").alias("hi"))


def listed_codes(index: DataFrame, lists: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What can be searched: codes (index_name, passage_id, list_id, codes) of the index's dims in lists that have a centroid, each row once;
    centroids (index_name, list_id, c); one row for each index that has codes (index_name, dims, n_lists, n_codes)."""
    known = info.groupBy("index_name").agg(F.min(F.struct(F.col("dims").cast("int").alias("dims"), F.col("n_lists").cast("long").alias("n_lists"))).alias("i")).select("index_name", "i.*")
    centroids = lists.join(known, "index_name").where(F.size("centroids") == F.col("dims")).groupBy("index_name", F.col("list_id").cast("int").alias("list_id")).agg(F.min("centroids").alias("c"))
    codes = index.join(known, "index_name").where((F.length("codes") * 8 == F.col("dims")) & F.col("passage_id").isNotNull())
    codes = codes.select("index_name", F.col("passage_id").cast("long").alias("passage_id"), F.col("list_id").cast("int").alias("list_id"), "codes").join(centroids.select("index_name", "list_id"), ["index_name", "list_id"], "left_semi").distinct()
    return codes, centroids, codes.groupBy("index_name").agg(F.count("*").alias("n_codes")).join(known, "index_name")


def assign_lists(index: DataFrame, lists: DataFrame, info: DataFrame, block_codes: int = BLOCK_CODES) -> DataFrame:
    """(index_name, passage_id, list_id, score_micro): the list of each code of every index: the centroid with the largest inner product with its
    ±1 numbers, ties to the smaller list. Repeated rows count once; null and cut-off codes, and indexes without centroids, have no list."""
    known = info.groupBy("index_name").agg(F.min(F.col("dims").cast("int")).alias("dims"))
    centroids = lists.join(known, "index_name").where(F.size("centroids") == F.col("dims")).groupBy("index_name", F.col("list_id").cast("long").alias("list_id")).agg(F.min("centroids").alias("c"))
    codes = index.join(known, "index_name").where((F.length("codes") * 8 == F.col("dims")) & F.col("passage_id").isNotNull()).select("index_name", F.col("passage_id").cast("long").alias("passage_id"), "codes").distinct()
    blocks = codes.groupBy("index_name").agg(F.ceil(F.count("*") / block_codes).cast("int").alias("blocks"))
    sizes = small(blocks, MAX_INDEXES, "indexes")
    a = codes.join(sizes, "index_name").withColumn("cb", F.pmod(F.xxhash64("passage_id"), F.col("blocks")).cast("int"))
    b = centroids.join(sizes, "index_name").withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def nearest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"index_name": pd.Series(dtype=object), "passage_id": pd.Series(dtype="int64"), "list_id": pd.Series(dtype="int64"), "score_micro": pd.Series(dtype="int64")})
        y = y.sort_values("list_id")
        c = np.stack(y["c"].tolist()).astype(np.float64)
        bits = np.unpackbits(np.frombuffer(b"".join(x["codes"].tolist()), np.uint8).reshape(len(x), -1), axis=1).astype(np.float64) * 2 - 1
        s = np.floor(bits @ c.T * 1e6 + 0.5).astype(np.int64)
        at = s.argmax(axis=1)
        return pd.DataFrame({"index_name": x["index_name"], "passage_id": x["passage_id"], "list_id": y["list_id"].to_numpy()[at], "score_micro": s[np.arange(len(s)), at]})

    a, b = a.select("index_name", "cb", "passage_id", "codes"), b.select("index_name", "cb", "list_id", "c")
    b = b.toDF("i", "k", "l", "x").toDF(*b.columns)  # columns of its own, for both sides have those of one table
    keys = ["index_name", "cb"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(nearest, "index_name string, passage_id long, list_id long, score_micro long")


def probe_topk(queries: DataFrame, index: DataFrame, lists: DataFrame, info: DataFrame, probe_codes: int = PROBE_CODES, nprobe: int = NPROBE, hamming_k: int = HAMMING_K, k: int = DENSE_K, block_queries: int = BLOCK_QUERIES, block_codes: int = BLOCK_CODES) -> DataFrame:
    """(query_id, index_name, passage_id, list_id, distance, score_micro, rank): the two-stage search of every index for every query.

    ``queries`` has query_id (unique) and vector; an index uses its first ``dims`` numbers, which the caller scales, and a shorter vector
    finds nothing there. The lists with the largest inner product of query and centroid are probed, as many as ``lists_for`` gives; of their codes the
    ``hamming_k`` nearest by differing bits are scored by the float query against the sign code, and the best ``k`` stay. Ties go to the
    smaller list, then to the smaller passage. Blocks of queries meet blocks of codes, each pair in one task that keeps its own
    ``hamming_k`` for each query, so no row is made for a code that is merely scanned.
    """
    codes, centroids, sizes = listed_codes(index, lists, info)
    spark = index.sparkSession
    sizes = sizes.select("index_name", "dims", lists_for(F.col("n_codes"), F.col("n_lists"), probe_codes, nprobe).alias("n_probe"), F.ceil(F.col("n_codes") / block_codes).cast("int").alias("blocks"))
    sizes = F.broadcast(spark.createDataFrame([tuple(r) for r in bounded_rows(sizes, MAX_INDEXES, "indexes")], "index_name string, dims int, n_probe long, blocks int"))
    q_blocks = max(1, -(-queries.count() // block_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    place = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("v")).crossJoin(sizes).where(F.size("v") >= F.col("dims"))
    q = q.select("index_name", place("query_id", F.lit(q_blocks)).alias("qb"), "query_id", F.slice("v", F.lit(1), F.col("dims")).alias("v"), "n_probe", "blocks")

    def choose(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = x.drop(columns="n_probe")
        if not len(x) or not len(y):
            return out.iloc[:0].assign(lists=pd.Series(dtype=object))
        y = y.sort_values("list_id")
        ids, c = y["list_id"].to_numpy(), np.stack(y["c"].tolist()).astype(np.float64)
        return out.assign(lists=[ids[np.argsort(-np.floor(c @ np.asarray(v) * 1e6 + 0.5), kind="stable")[:n]] for v, n in zip(x["v"], x["n_probe"])])

    probed = q.groupBy("index_name", "qb").cogroup(centroids.withColumn("qb", every(F.lit(q_blocks))).groupBy("index_name", "qb")).applyInPandas(choose, "index_name string, qb int, query_id long, v array<double>, blocks int, lists array<int>")
    a = probed.withColumn("cb", every(F.col("blocks")))
    b = codes.join(sizes, "index_name").select("index_name", "passage_id", "list_id", "codes", place("passage_id", F.col("blocks")).alias("cb")).withColumn("qb", every(F.lit(q_blocks)))

    def scan(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "index_name": pd.Series(dtype=object), "passage_id": pd.Series(dtype="int64"), "list_id": pd.Series(dtype="int32"), "distance": pd.Series(dtype="int64"), "score_micro": pd.Series(dtype="int64")})]
        if len(x) and len(y):
            y = y.sort_values(["list_id", "passage_id", "codes"])
            bits = np.frombuffer(b"".join(y["codes"].tolist()), np.uint8).reshape(len(y), -1)
            ids, of = y["passage_id"].to_numpy(), y["list_id"].to_numpy()
            for i, v, wanted in zip(x["query_id"], x["v"], x["lists"]):
                v = np.asarray(v)
                at = np.flatnonzero(np.isin(of, wanted))
                d = np.bitwise_count(bits[at] ^ np.packbits(v > 0)).sum(axis=1, dtype=np.int64)
                keep = np.lexsort((ids[at], of[at], d))[:hamming_k]
                at, d = at[keep], d[keep]
                s = np.floor((np.unpackbits(bits[at], axis=1).astype(np.float64) * 2 - 1) @ v * 1e6 + 0.5).astype(np.int64)
                out.append(pd.DataFrame({"query_id": i, "index_name": y["index_name"].iloc[0], "passage_id": ids[at], "list_id": of[at], "distance": d, "score_micro": s}))
        return pd.concat(out[1:] or out)

    keys = ["index_name", "qb", "cb"]
    near = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(scan, "query_id long, index_name string, passage_id long, list_id int, distance long, score_micro long")
    one = Window.partitionBy("index_name", "query_id")
    near = near.withColumn("_h", F.row_number().over(one.orderBy("distance", "list_id", "passage_id", F.desc("score_micro")))).where(F.col("_h") <= hamming_k).drop("_h")
    return near.withColumn("rank", F.row_number().over(one.orderBy(F.desc("score_micro"), "list_id", "passage_id", "distance")).cast("long")).where(F.col("rank") <= k)


def single_list(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """(list_id, n, centroid): one list 0 for a small index, its centroid the mean of all vectors, scaled to length 1. No vectors, no list."""
    places = vectors.where(F.col(vector).isNotNull()).select(F.posexplode(vector).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    mean = places.agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("c")).where("n is not null")
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda acc, x: acc + x * x))
    return mean.select(F.lit(0).alias("list_id"), "n", F.when(norm > 0, F.transform("c", lambda x: x / norm)).otherwise(F.col("c")).alias("centroid"))


def quantized(vector: Column, steps: int = 127) -> Column:
    """A vector of numbers in [-1, 1] as whole numbers of a byte; halves round away from zero."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-steps), F.least(F.lit(steps), F.round(x * steps).cast("int"))).cast("tinyint"))
