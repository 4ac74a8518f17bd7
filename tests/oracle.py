"""Compare a query with its SQL on the same tables in DuckDB."""

import glob
import os
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connect(folder=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return con


def plain(x):
    s = str(x)
    if x is None or s in ("NaT", "<NA>", "nan", "None"):
        return "NULL"
    if type(x).__name__ in ("bool", "bool_"):
        return s
    try:
        return f"{float(x):.8g}" if type(x).__name__ != "str" else s
    except (TypeError, ValueError):
        return s


def rows(frame):
    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def same(spark, con, query, sql, folder=DATA):
    got, want = query(spark, str(folder)).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
