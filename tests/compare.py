"""Run queries and their checking SQL side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql) -> str | None:
    """None when both sides agree, else a short account of how they differ."""
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(rel.columns, rel.fetchall())
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:3]
    lost = [r for r in want if r not in set(got)][:3]
    return f"{len(got)} / {len(want)} rows; spark only {extra}; sql only {lost}"
