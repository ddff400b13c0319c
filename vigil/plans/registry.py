"""Name → (Spark query, DuckDB oracle) registry filled by the catalog modules."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, fn: QueryFn, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"duplicate query name {name}")
    QUERIES[name] = fn
    if sql is not None:
        # some oracles fold sequences with recursive CTEs; RECURSIVE is harmless elsewhere
        if sql.startswith("WITH ") and not sql.startswith("WITH RECURSIVE "):
            sql = "WITH RECURSIVE " + sql[len("WITH "):]
        ORACLES[name] = sql
