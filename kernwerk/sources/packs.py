"""Packs on disk: tables as Parquet in one folder, a manifest with hashes, verification, import, and the library of installed packs."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tarfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMAT = 1
TABLES = ("articles", "passages", "redirects", "sources", "questions", "cards", "codes", "centroids", "props", "entities", "facts")
MANIFEST_SCHEMA = "pack_id STRING, pack_type STRING, format_version INT, build_date STRING, snapshot_date STRING, license STRING, replaces ARRAY<STRING>, embedder STRING, counts STRUCT<articles: LONG, passages: LONG>, files ARRAY<STRUCT<path: STRING, bytes: LONG, sha256: STRING>>"


def write_table(df: DataFrame, pack: str, name: str, order: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    """One table of a pack: zstd Parquet, sorted within files for row-group pruning, written beside and renamed by the commit protocol."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    w = (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{pack}/{name}")


def read_table(spark: SparkSession, pack: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{pack}/{name}")


def get_passages(passages: DataFrame, ids: DataFrame) -> DataFrame:
    """The passages of some ids: a semi-join, whose small side the optimizer may broadcast after seeing its size."""
    return passages.join(ids.select("passage_id").distinct(), "passage_id", "left_semi")


def violations(articles: DataFrame, passages: DataFrame) -> DataFrame:
    """(rule, n): broken invariants of a pack: ids dense from 0, passages of known articles, counts and starts that agree."""
    dense = lambda df, c, rule: df.agg(F.count("*").alias("n"), F.countDistinct(c).alias("d"), F.min(c).alias("lo"), F.max(c).alias("hi")).select(F.lit(rule).alias("rule"), F.when((F.col("n") == 0) | ((F.col("n") == F.col("d")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)), 0).otherwise(1).alias("n"))
    orphan = passages.join(articles, "article_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("passage without article").alias("rule"), "n")
    real = passages.groupBy("article_id").agg(F.count("*").alias("c"), F.min("passage_id").alias("f"))
    wrong = articles.join(real, "article_id", "left").where(~(F.col("c").eqNullSafe(F.col("n_passages")) & F.col("f").eqNullSafe(F.col("first_passage")))).agg(F.count("*").alias("n")).select(F.lit("count or start of an article").alias("rule"), "n")
    return dense(articles, "article_id", "article ids").unionByName(dense(passages, "passage_id", "passage ids")).unionByName(orphan).unionByName(wrong).where("n > 0")


def file_hashes(spark: SparkSession, pack: str) -> DataFrame:
    """(path, bytes, sha256) of all files but the manifest, hashed where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pack)
    path = F.regexp_replace("path", "^.*?" + "/" + os.path.basename(pack.rstrip("/")) + "/", "")
    return files.where(~F.col("path").endswith("/manifest.json") & ~F.col("path").rlike(r"/[._][^/]*$")).select(path.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, pack: str, **fields) -> dict:
    rows = [r.asDict() for r in file_hashes(spark, pack).orderBy("path").collect()]
    doc = {"format_version": FORMAT, "pack_type": "knowledge", "replaces": [], **fields, "files": rows}
    tmp = Path(pack) / ".manifest.tmp"
    tmp.write_text(json.dumps(doc, indent=1))
    tmp.rename(Path(pack) / "manifest.json")
    return doc


def verify(spark: SparkSession, pack: str) -> DataFrame:
    """(path) of files whose size or hash differs from the manifest, or that are missing."""
    m = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(f"{pack}/manifest.json")
    want = m.select(F.explode("files").alias("f")).select("f.path", "f.bytes", "f.sha256")
    got = file_hashes(spark, pack).toDF("path", "b", "h")
    return want.join(got, "path", "left").where(~(F.col("bytes").eqNullSafe(F.col("b")) & F.col("sha256").eqNullSafe(F.col("h")))).select("path")


def bundle(pack: str, out: str, part_size: int = 1 << 30) -> list[dict]:
    """A tar of a pack in parts of at most ``part_size`` bytes, with the hash of each."""
    whole = Path(out).with_suffix(".tar.tmp")
    with tarfile.open(whole, "w") as t:
        t.add(pack, arcname=os.path.basename(pack.rstrip("/")))
    parts = []
    with whole.open("rb") as f:
        while f.peek(1):
            p = Path(f"{out}.{len(parts):03d}")
            with p.open("wb") as to:
                n, digest = _copied(f, to, part_size)
            parts.append({"path": str(p), "bytes": n, "sha256": digest})
    whole.unlink()
    return parts


def _copied(source, to, most: int, chunk: int = 1 << 20, seen: Callable[[int], None] = lambda n: None) -> tuple[int, str]:
    """Bytes copied from one open file to another, at most ``most``, and their hash; a chunk at a time is in memory."""
    digest, n = hashlib.sha256(), 0
    while n < most and (data := source.read(min(chunk, most - n))):
        to.write(data)
        digest.update(data)
        n += len(data)
        seen(len(data))
    return n, digest.hexdigest()


def install(spark: SparkSession, parts: Iterable[dict], library: str, accept: Callable[[dict], bool] = lambda m: True, progress: Callable[[int], None] = lambda n: None) -> str:
    """Check and unpack a bundle into a library; nothing is installed unless every part and every file is right. Returns the pack's folder."""
    stage = Path(library) / ".staging"
    shutil.rmtree(stage, ignore_errors=True)
    stage.mkdir(parents=True)
    try:
        whole = stage / "pack.tar"
        with whole.open("wb") as f:
            for p in parts:
                with open(p["path"], "rb") as part:
                    got = _copied(part, f, p["bytes"] + 1, seen=progress)
                if got != (p["bytes"], p["sha256"]):
                    raise ValueError(f"damaged part {p['path']}")
        with tarfile.open(whole) as t:
            t.extractall(stage, filter="data")  # refuses paths that leave the folder
        whole.unlink()
        (root,) = [p for p in stage.iterdir() if p.is_dir()]
        doc = json.loads((root / "manifest.json").read_text())
        if doc.get("format_version") != FORMAT or not accept(doc):
            raise ValueError("pack not accepted")
        if bad := [r["path"] for r in verify(spark, str(root)).limit(5).collect()]:
            raise ValueError(f"damaged files {bad}")
        target = Path(library) / doc["pack_id"]
        if target.exists():
            shutil.rmtree(target)
        root.rename(target)
        return str(target)
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def usable_packs(packs: DataFrame, disabled: list[str], most: int = 255) -> DataFrame:
    """Installed packs that take part: not disabled, not replaced by an enabled pack, and of the first pack's embedder (user documents excepted)."""
    on = packs.where(~F.col("pack_id").isin(disabled) if disabled else F.lit(True))
    replaced = on.select(F.explode("replaces").alias("pack_id")).distinct()
    left = on.join(replaced, "pack_id", "left_anti")
    w = Window.partitionBy(F.lit(0)).orderBy("pack_id")
    first = F.first("embedder", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return left.withColumn("_e", first).where(F.col("embedder").isNull() | (F.col("embedder") == F.col("_e")) | (F.col("pack_type") == "user")).drop("_e").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def merge_catalogs(new: DataFrame, old: DataFrame) -> DataFrame:
    """Newly built packs win over the previous catalogue's; recommended ones first, then by id."""
    rows = new.withColumn("_o", F.lit(0)).unionByName(old.withColumn("_o", F.lit(1)))
    pick = F.row_number().over(Window.partitionBy("pack_id").orderBy("_o"))
    return rows.withColumn("_p", pick).where("_p = 1").drop("_p", "_o").orderBy(~F.col("recommended"), "pack_id")


def updates(catalog: DataFrame, installed: DataFrame) -> DataFrame:
    """Packs whose catalogue build is newer than the installed one."""
    return catalog.join(installed.select("pack_id", F.col("build_date").alias("have")), "pack_id").where(F.col("build_date") > F.col("have"))


def library_totals(installed: DataFrame, without: list[str]) -> DataFrame:
    """Bytes of installed packs, and the snapshot date of the largest."""
    rows = installed.where(~F.col("pack_id").startswith(".") & ~F.col("pack_id").isin(without or [""]))
    return rows.agg(F.sum("bytes").alias("bytes"), F.max_by("snapshot_date", "passages").alias("snapshot_date"))


def notices(sections: DataFrame) -> DataFrame:
    """(book, chapters, url, authors, licences): one credit line for each book; the most common URL, all authors and licences in order."""
    u = sections.groupBy("book", "url").agg(F.count("*").alias("n")).groupBy("book").agg(F.min_by("url", F.struct(-F.col("n"), F.col("url"))).alias("url"))
    a = sections.groupBy("book").agg(F.count("*").alias("chapters"), F.array_join(F.array_sort(F.collect_set("author")), ", ").alias("authors"), F.array_join(F.array_sort(F.collect_set("licence")), ", ").alias("licences"))
    return a.join(u, "book")
