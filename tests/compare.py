"""Run a registered query next to its SQL and compare schema, rows and values."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark type -> DuckDB type
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def differences(spark_df, con, sql: str, shown: int = 3) -> list[str]:
    result = con.sql(sql)
    expected_types = dict(zip(result.columns, map(str, result.types)))
    problems = []
    found_types = {n: TYPES.get(t, t) for n, t in spark_df.dtypes}
    if found_types != expected_types:
        problems.append(f"schema: spark {found_types} / sql {expected_types}")
    columns = sorted(expected_types)
    if sorted(found_types) != columns:
        return problems
    order = [result.columns.index(c) for c in columns]
    want = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    got = Counter(
        tuple(_plain(v) for v in row) for row in map(tuple, spark_df.select(*[f"`{c}`" for c in columns]).collect())
    )
    if got != want:
        problems.append(f"rows: spark {got.total()} / sql {want.total()}")
        problems.append(f"only spark: {list((got - want).items())[:shown]}")
        problems.append(f"only sql:   {list((want - got).items())[:shown]}")
    elif not got:
        problems.append("empty result")
    return problems
