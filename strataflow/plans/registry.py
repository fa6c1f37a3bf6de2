"""Names of all queries, with their callables and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with its SQL where SQL can express it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def load() -> None:
    """Imports the modules that register queries."""
    import importlib

    for name in ("history", "snapshots", "runtime", "retrieval", "graph", "text", "questions", "lookup", "memory", "verify", "claims", "fusion", "comprehension", "exports", "evidence", "streams", "more", "ingest"):
        importlib.import_module(f"strataflow.plans.{name}")
