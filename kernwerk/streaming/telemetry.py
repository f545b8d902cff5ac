"""Streams over telemetry and evaluation rows: append-only sinks, windows with late data, resumable runs, and the ring of recent questions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = "record_id LONG, ts TIMESTAMP, query STRING, search_query STRING, intent STRING, total_ms DOUBLE, error STRING, stages ARRAY<STRUCT<stage: STRING, ms: DOUBLE>>"


def read_records(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """A stream of JSON lines files as they arrive."""
    return spark.readStream.schema(schema).json(path)


def without_text(records: DataFrame, columns: tuple[str, ...] = ("query", "search_query")) -> DataFrame:
    """Records with their texts blanked, for logs that may not hold any."""
    return records.withColumns({c: F.lit("") for c in columns if c in records.columns})


def windowed(records: DataFrame, length: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts, errors and mean time per window of event time; rows later than the watermark are dropped, repeated records count once."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    once = records.withWatermark("ts", late).dropDuplicatesWithinWatermark(["record_id"]) if records.isStreaming else records.dropDuplicates(["record_id"])
    return once.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.avg("total_ms").alias("mean_ms")).select("w.start", "w.end", "n", "errors", "mean_ms")


def sessions(records: DataFrame, gap: str = "30 minutes", late: str = "2 hours", by: str = "intent") -> DataFrame:
    """Sessions of one key: rows that follow each other within the gap."""
    rows = records.withWatermark("ts", late) if records.isStreaming else records
    return rows.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, "w.start", "w.end", "n")


def append_jsonl(records: DataFrame, path: str, checkpoint: str):
    """Append a stream as JSON lines; the file sink commits each batch once."""
    return records.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def pruned(records: DataFrame, most_bytes: int = 1 << 20, order: str = "ts") -> DataFrame:
    """The latest records whose JSON lines fit ``most_bytes`` together, for a log that must stay small: a histogram of sizes by day drops whole
    days first, so that only the day on which the limit falls is put in order."""
    from pyspark.sql import Window

    rows = records.withColumn("_size", F.octet_length(F.to_json(F.struct(*records.columns))) + 1).withColumn("_day", F.to_date(order))
    newer = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each day of the log
    days = rows.groupBy("_day").agg(F.sum("_size").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(newer), F.lit(0))).where(F.col("_before") < most_bytes).select(F.col("_day").alias("_d"), "_before")
    kept = rows.join(days, F.col("_day").eqNullSafe(F.col("_d")))
    upto = F.sum("_size").over(Window.partitionBy("_day").orderBy(F.desc(order), *sorted(c for c in records.columns if c != order)).rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("_upto", F.col("_before") + upto).where(F.col("_upto") <= most_bytes).select(*records.columns)


def resume(requests: DataFrame, done: DataFrame, key: str = "id", failed: Column | None = None) -> DataFrame:
    """Requests without a finished row; rows that failed are tried again."""
    finished = done if failed is None else done.where(~failed)
    return requests.join(finished.select(key).distinct(), key, "left_anti")


def run_resumable(requests: DataFrame, out: str, checkpoint: str, work, key: str = "id"):
    """A streaming run: every batch skips the keys already written, does the work and appends the rows."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        rows = rows.dropDuplicates([key])
        try:
            rows = resume(rows, spark.read.parquet(out), key)
        except Exception as e:  # the first batch: nothing is written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        work(rows).write.mode("append").parquet(out)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent(records: DataFrame, n: int = 20, by: str = "intent") -> DataFrame:
    """The latest n questions of each key, as a stateful stream that emits the ring whenever it changes."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for p in parts:
            held += list(zip(p["ts"].astype("int64").tolist(), p["query"].fillna("").tolist()))
        held = sorted(set(held), reverse=True)[:n]
        state.update(([t for t, _ in held], [q for _, q in held]))
        yield pd.DataFrame({by: key[0], "place": range(1, len(held) + 1), "query": [q for _, q in held]})

    return records.groupBy(by).applyInPandasWithState(update, f"{by} STRING, place INT, query STRING", "ts ARRAY<LONG>, query ARRAY<STRING>", "update", "NoTimeout")


def changed_texts(new: DataFrame, old: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(reused, missing): passages whose text has a code already, and those to encode; matched by a 256-bit hash of the text."""
    n = new.withColumn("_h", F.sha2(text, 256))
    o = old.select("_h", "code").dropDuplicates(["_h"])
    return n.join(o, "_h").drop("_h"), n.join(o, "_h", "left_anti").drop("_h")
