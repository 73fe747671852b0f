"""Compares a query with its SQL on one folder of tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _cell(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def differences(name: str, frame, sql: str, connection: duckdb.DuckDBPyConnection) -> str | None:
    """None when columns, number types and all values agree."""
    answer = connection.execute(sql)
    sql_columns = [column[0] for column in answer.description]
    expected = rows_of(sql_columns, answer.fetchall())
    actual = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    if sorted(frame.columns) != sorted(sql_columns):
        return f"{name}: columns {sorted(frame.columns)} != {sorted(sql_columns)}"
    if len(actual) != len(expected):
        return f"{name}: {len(actual)} rows, SQL has {len(expected)}"
    for got, wanted in zip(actual, expected):
        if got != wanted:
            return f"{name}: {got} != {wanted}"
    return None
