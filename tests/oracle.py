"""Compares a query with its SQL in DuckDB over the same tables, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        source = path if path.is_file() else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(norm, value))
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, queries, sql, name: str, sf_dir: str) -> tuple[int, str]:
    """Number of rows and an empty string if equal, else what differs."""
    df = queries[name](spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = connect(sf_dir).execute(sql[name])
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return sum(ours.values()), f"columns {sorted(df.columns)} and {sorted(columns)}"
    if ours != theirs:
        return sum(ours.values()), f"only ours {list((ours - theirs).items())[:4]}, only SQL {list((theirs - ours).items())[:4]}, {sum(ours.values())} and {sum(theirs.values())} rows"
    return sum(ours.values()), ""
