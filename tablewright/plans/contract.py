"""Registered queries: name, Spark callable over (session, table folder), oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that must give the same rows."""
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f
    return register


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from . import cleaning, loading, profiling, questions, storing, texts  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
