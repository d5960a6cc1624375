"""Order-insensitive comparison of a query with its checking SQL."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def open_tables(sf_dir: str):
    """An in-process DuckDB with one view per given table."""
    checker = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        checker.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return checker


# The same type in both engines.
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, bool):
        return f"bool {value}"
    if isinstance(value, int):
        return f"int {value}"
    if isinstance(value, float):
        return f"float {value!r}" if value else "float 0.0"
    return repr(value)


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, checker, sql: str) -> list[str]:
    """Empty when columns and rows agree, value types included."""
    cursor = checker.execute(sql)
    expected_columns = [column[0] for column in cursor.description]
    expected = cursor.fetchall()
    if sorted(df.columns) != sorted(expected_columns):
        return [f"columns {sorted(df.columns)} != {sorted(expected_columns)}"]
    expected_types = dict(row[:2] for row in checker.execute(f"DESCRIBE {sql}").fetchall())
    other_types = [f"{name} {kind} != {expected_types[name]}" for name, kind in df.dtypes if TYPES[kind] != expected_types[name]]
    if other_types:
        return other_types
    found = _rows(df.columns, df.collect())
    wanted = _rows(expected_columns, expected)
    if found == wanted:
        return []
    return [f"rows {sum(found.values())} != {sum(wanted.values())}"] * (sum(found.values()) != sum(wanted.values())) + [
        f"only found: {list((found - wanted).items())[:3]}",
        f"only expected: {list((wanted - found).items())[:3]}",
    ]
