"""Compare registered queries with their SQL on DuckDB, as value multisets."""

from __future__ import annotations

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SPARK_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "FLOAT": "float",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if value is None or value != value:
        return "null"
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def multiset(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when equal in columns, types and values, else a short description."""
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    sql_types = {name: SPARK_TYPES.get(kind, kind) for name, kind, *_ in described}
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if sql_types != spark_types:
        return f"schema {spark_types} != {sql_types}"
    left = multiset(df.columns, df.collect())
    right = multiset([d[0] for d in described], con.execute(sql).fetchall())
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} of {len(left)} rows differ, e.g. {wrong[0]}" if wrong else None
