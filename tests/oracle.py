"""Run a query and its SQL twin over the same tables and compare rows by value."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def differences(df, con, sql: str, limit: int = 5) -> list[str]:
    """Empty if both sides agree in column names, row count and values."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    expected = _sorted(cursor.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    got = _sorted(df.collect(), df.columns)
    if len(got) != len(expected):
        return [f"{len(got)} rows against {len(expected)}"]
    return [f"{g} against {e}" for g, e in zip(got, expected) if g != e][:limit]
