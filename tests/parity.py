"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if Path(path).is_dir() else ''}')")
    return con


def shown(value) -> str:
    if value is None or str(value) in ("NaT", "<NA>", "nan"):
        return "null"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19].replace("T00:00:00", "")
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    if isinstance(value, float) or "float" in type(value).__name__:
        return f"{float(value):.6g}" if abs(value) > 1e-12 else "0"
    if "int" in type(value).__name__ or type(value).__name__ == "Decimal":
        return f"{float(value):.6g}" if abs(value) > 1e-12 else "0"
    return str(value)


def rows_of(frame) -> list[tuple[str, ...]]:
    names = sorted(frame.columns)
    return sorted(tuple(shown(v) for v in row) for row in frame[names].itertuples(index=False, name=None))


def compare(df, sql: str, con) -> str:
    """What differs, or the empty string."""
    ours, theirs = df.toPandas(), con.execute(sql).fetch_df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} {sorted(theirs.columns)}"
    a, b = rows_of(ours), rows_of(theirs)
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{len(a)} and {len(b)} rows; ours only {only_a}; SQL only {only_b}"
