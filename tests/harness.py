"""Compare a query with its SQL in DuckDB: same columns, same rows."""

from __future__ import annotations

import glob
import math
import os
import sys

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, name, sf_dir, entry):
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    return got, want


def local_spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()


if __name__ == "__main__":
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    spark = local_spark()
    spark.sparkContext.setLogLevel("ERROR")
    args = [a for a in sys.argv[1:] if not a.startswith("/")]
    sf = next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    names = [n for n in entry.queries() if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    for n in names:
        t = time.time()
        try:
            if n in entry.oracle_sql():
                got, want = compare(spark, n, sf, entry)
                ok = got == want
                print(n, "OK" if ok else "DIFF", len(got[1]), len(want[1]), f"{time.time() - t:.1f}s", flush=True)
                if not ok:
                    print("  columns", got[0], want[0])
                    a, b = set(got[1]), set(want[1])
                    print("  only spark", sorted(a - b)[:4], len(a - b), "\n  only sql  ", sorted(b - a)[:4], len(b - a), flush=True)
            else:
                df = entry.queries()[n](spark, sf)
                print(n, "rows only", df.count(), df.columns[:12], f"{time.time() - t:.1f}s", flush=True)
        except Exception as e:
            print(n, "ERROR", str(e)[:1500], flush=True)
