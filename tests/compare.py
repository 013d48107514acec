"""A query's rows against its SQL's rows in DuckDB, over one data folder."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def connect() -> duckdb.DuckDBPyConnection:
    """DuckDB with every table of the folder as a view."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in sorted(DATA.glob("*.parquet")):
        source = path if path.is_file() else path / "*.parquet"
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return con


def plain(value: object) -> object:
    """Values as both engines can be compared."""
    if isinstance(value, float):
        return None if value != value else value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    return value


def rows_of(columns: list[str], rows: list) -> list[str]:
    """Rows with columns in order of name, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(row[i]) for i in order)) for row in rows)


def differences(spark, query, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    df, rel = query(spark, str(DATA)), connect().sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    left, right = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    return "" if left == right else f"{len(left)} and {len(right)} rows; {set(left) - set(right)} / {set(right) - set(left)}"[:2000]
