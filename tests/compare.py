"""Compares a Spark result with a DuckDB result over the same Parquet files."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def normalised(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    got_cols = spark_df.columns
    got = normalised(spark_df.collect(), got_cols)
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = normalised(cur.fetchall(), want_cols)
    out = []
    if sorted(got_cols) != sorted(want_cols):
        return [f"columns {sorted(set(got_cols) ^ set(want_cols))}"]
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        cols = sorted(got_cols)
        a = [r for r in got if r not in set(want)][:2]
        b = [r for r in want if r not in set(got)][:2]
        out.append(f"{cols}\n   spark {a}\n   duck  {b}")
    if not got:
        out.append("EMPTY")
    return out
