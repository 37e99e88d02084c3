"""Runs a registered query beside its SQL on the same parquet tables and compares the rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return str(v)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> list:
    got, names = spark_df.collect(), spark_df.columns
    cur = con.execute(sql)
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(names) != sorted(want_names):
        return [("columns", sorted(names), sorted(want_names))]
    a, b = rows_of(names, got), rows_of(want_names, want)
    return [("only spark", *list((a - b).items())[:2]), ("only sql", *list((b - a).items())[:2])] if a != b else []
