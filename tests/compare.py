"""Runs registered queries next to their SQL on the same tables and compares whole results."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def _sorted(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


_KINDS = {
    "bigint": "int64", "int": "int32", "string": "varchar", "double": "double", "boolean": "boolean",
    "timestamp_ntz": "timestamp", "date": "date", "timestamp": "timestamp with time zone",
}


def differences(df, connection, sql: str) -> list[str]:
    relation = connection.sql(sql)
    expected_columns, expected = _sorted(relation.columns, relation.fetchall())
    actual_columns, actual = _sorted(df.columns, df.collect())
    if actual_columns != expected_columns:
        return [f"columns {actual_columns} != {expected_columns}"]
    notes = []
    spark_types = dict(df.dtypes)
    for name, kind in zip(relation.columns, relation.types):
        kind = {"bigint": "int64", "integer": "int32"}.get(str(kind).lower(), str(kind).lower())
        mapped = _KINDS.get(spark_types[name])
        if mapped and mapped != kind:
            notes.append(f"type of {name}: {spark_types[name]} against {kind}")
    if len(actual) != len(expected):
        notes.append(f"{len(actual)} rows, expected {len(expected)}")
    if actual != expected:
        only_actual = sorted(set(actual) - set(expected), key=repr)[:3]
        only_expected = sorted(set(expected) - set(actual), key=repr)[:3]
        notes.append(f"only Spark: {only_actual}\n   only SQL: {only_expected}")
    if not expected:
        notes.append("empty result")
    return notes
