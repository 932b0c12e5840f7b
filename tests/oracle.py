"""Compares a query with its DuckDB SQL: columns by name, rows as bags."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "is_finite"):
        return round(float(value), 9)
    return value


def bag(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, sf_dir)
    got = bag(df.columns, df.collect())
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    want = bag(columns, found.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if got == want:
        return ""
    missing, extra = [x for x in want if x not in set(got)][:3], [x for x in got if x not in set(want)][:3]
    return f"{len(got)} and {len(want)} rows; only in SQL {missing}; only in Spark {extra}"
