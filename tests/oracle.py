"""Compare a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "None"
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """Empty string if equal, else what differs."""
    rel = con.sql(sql)
    names = list(rel.columns)
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    want, got = rows_of(names, rel.fetchall()), rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if want == got:
        return ""
    a, b = set(want), set(got)
    only_sql, only_spark = sorted(a - b)[:2], sorted(b - a)[:2]
    return f"{len(got)} rows vs {len(want)}; {len(b - a)} differ\n  sql   {only_sql}\n  spark {only_spark}"[:1500]
