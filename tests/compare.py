"""Side-by-side comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import hashlib
import math
from pathlib import Path

import duckdb

from cargolens.sources.star_schema import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value) -> str:
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def table(columns: list[str], rows) -> tuple[list[str], list[tuple[str, ...]]]:
    """Columns by name, rows in order of their text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted(tuple(_cell(row[i]) for i in order) for row in rows),
    )


def differences(frame, connection, sql: str) -> str | None:
    """None if both sides have the same columns and rows, else the first differences."""
    left = table(frame.columns, frame.collect())
    result = connection.execute(sql)
    right = table([c[0] for c in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        return None
    extra = sorted(set(left[1]) - set(right[1]))[:3]
    missing = sorted(set(right[1]) - set(left[1]))[:3]
    return f"rows {len(left[1])} vs {len(right[1])}; only Spark {extra}; only SQL {missing}"


def digest(frame) -> str:
    columns, rows = table(frame.columns, frame.collect())
    return hashlib.sha256(repr((columns, rows)).encode()).hexdigest()
