"""Session helpers: table access, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The folder is the session's ``spark.checkpoint.dir``. Only where it is unset and all runs on one machine (tests) a temporary folder is
    used; a cluster without a shared folder is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set first where it is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="kernwerk-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str, by: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder, in one directory for each value of ``by``, and read from there."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(folder)
    return spark.read.parquet(folder)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table with a stated bound, on the driver. Raises instead of cutting when there are more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; it is meant for a bounded table")
    return rows


def small(df: DataFrame, limit: int, what: str) -> DataFrame:
    """``df`` to be broadcast, once its rows are seen to be at most ``limit``; raises otherwise."""
    return F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in bounded_rows(df, limit, what)], df.schema))


def salted(df: DataFrame, id_col: str, salts: int) -> DataFrame:
    """Adds ``_salt`` in [0, salts) from a hash of ``id_col``: the same row gets the same salt in every attempt of a task."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int"))


def replicated(df: DataFrame, salts: int) -> DataFrame:
    """One copy of each row for each salt: the other side of a join on (key, _salt)."""
    return df.withColumn("_salt", F.explode(F.array([F.lit(i) for i in range(salts)])))


_HASHES = 1 << 60


def hash_sample(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """All rows if there are at most ``size``, else about ``size`` of them: those with the smallest hashes of their keys.

    The bound on the hash comes from the count, so that each task drops the others by itself; a sorted limit would send ``size`` rows of
    every task to one place. The same rows come in every run and layout.
    """
    n = df.count()
    return df if n <= size else df.where(F.pmod(F.xxhash64(*keys), F.lit(_HASHES)) < F.lit(int(size / n * _HASHES)))
