"""Spark result against DuckDB result, as multisets of rows with columns in name order."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb

from linemend.queries.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return f"D{value}"
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}


def type_difference(df, connection, sql: str) -> str | None:
    """None when column types agree, else the columns that do not."""
    expected = {row[0]: row[1] for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
    actual = {name: TYPES.get(kind, kind.upper()) for name, kind in df.dtypes}
    wrong = {name: (kind, expected.get(name)) for name, kind in actual.items() if expected.get(name) != kind}
    return str(wrong) if wrong else None


def difference(df, connection, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = connection.execute(sql)
    expected_columns, expected = _bag([d[0] for d in result.description], result.fetchall())
    columns, actual = _bag(df.columns, [tuple(row) for row in df.collect()])
    if columns != expected_columns:
        return f"columns {columns} instead of {expected_columns}"
    if actual == expected:
        return None
    extra, missing = list((actual - expected).items())[:3], list((expected - actual).items())[:3]
    return f"{actual.total()} rows instead of {expected.total()}; only here {extra!r:.700}; only expected {missing!r:.700}"
