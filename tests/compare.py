"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def multiset(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df, relation) -> str | None:
    """None if both hold the same rows under the same column names, else what differs."""
    names = relation.columns
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    left = multiset(df.columns, [tuple(r) for r in df.collect()])
    right = multiset(names, relation.fetchall())
    if left == right:
        return None
    only_left, only_right = left - right, right - left
    return f"{sum(only_left.values())} / {sum(only_right.values())} rows differ: {list(only_left)[:2]} vs {list(only_right)[:2]}"
