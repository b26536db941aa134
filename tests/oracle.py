"""Compare a Spark query with its SQL oracle on the same Parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb

TABLES = "/root/testdata/{}"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return f"{value:.9g}" if value == value else "nan"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def multiset(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_type(t: str) -> str:
    return {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE"}.get(t, t.upper())


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences between the query and the oracle; empty if there are none."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = multiset(names, result.fetchall())
    found = multiset(df.columns, df.collect())
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    elif len(expected) != len(found):
        problems.append(f"rows {len(found)} != {len(expected)}")
    elif expected != found:
        first = next((a, b) for a, b in zip(found, expected) if a != b)
        problems.append(f"values differ, first: {str(first[0])[:700]} != {str(first[1])[:700]}")
    types = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    for name, dtype in df.dtypes:
        if name in types and spark_type(dtype).replace(" ", "") != types[name].replace(" ", ""):
            problems.append(f"type of {name}: {spark_type(dtype)} != {types[name]}")
    return problems
