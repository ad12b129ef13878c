"""Run registered queries in Spark and their SQL in DuckDB and compare."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False, name=None):
        out = []
        for v in row:
            if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
                out.append(None)
            elif hasattr(v, "item"):
                out.append(v.item())
            else:
                out.append(v)
        rows.append(tuple(None if isinstance(v, float) and v != v else v for v in out))
    return sorted(rows, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, con, name, run, sql, folder) -> str:
    began = time.time()
    got = run(spark, folder).toPandas()
    took = time.time() - began
    if sql is None:
        return f"rows-only {len(got)} rows {took:.1f}s"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"DIFF columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if len(a) != len(b):
        return f"DIFF rows {len(a)} vs {len(b)} {took:.1f}s"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"DIFF {len(bad)}/{len(a)} values e.g. {bad[0]} {took:.1f}s"
    kinds = [
        (c, str(got[c].dtype), str(want[c].dtype))
        for c in sorted(got.columns)
        if str(got[c].dtype) != str(want[c].dtype)
    ]
    note = f" types {kinds}" if kinds else ""
    return f"ok {len(a)} rows {took:.1f}s{note}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    from weftspan.catalog.registry import load

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    con = duck(folder)
    for name, entry in load().items():
        if wanted and not any(name == w or name.startswith(w.rstrip("*")) and w.endswith("*") for w in wanted):
            continue
        try:
            print(name, "->", compare(session, con, name, entry.run, entry.sql, folder), flush=True)
        except Exception as error:  # report and go on
            print(name, "-> ERROR", type(error).__name__, str(error)[:1500], flush=True)
