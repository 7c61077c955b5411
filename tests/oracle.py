"""Compare Spark results with DuckDB, value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v) -> str:
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return "~" if math.isnan(v) else repr(v + 0.0) if v != int(v) or abs(v) > 1e15 else str(int(v))
    return str(v)


def _lines(columns, rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    rel = con.sql(sql)
    want_cols, want_rows = rel.columns, rel.fetchall()
    got_rows = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(set(df.columns) ^ set(want_cols))}"
    got, want = _lines(df.columns, got_rows), _lines(want_cols, want_rows)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]} columns {sorted(df.columns)}"
    return None if got else "no rows on either side"
