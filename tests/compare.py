"""Compare a query with its SQL on the same files, row by row, without regard to order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{directory}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(value):
    if isinstance(value, float):
        return ("f", None if math.isnan(value) else float(f"{value:.12g}"))
    return (type(value).__name__, value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_key(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql) -> str | None:
    """None if both sides agree, else a short account."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    expected = _rows(names, cursor.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if actual == expected:
        return None
    extra = [r for r in actual if r not in expected[:5000]][:1]
    missing = [r for r in expected if r not in actual[:5000]][:1]
    return f"{len(actual)} rows != {len(expected)}; extra {extra}; missing {missing}"
