"""Every registered query with its SQL twin; modules of lectern.plans add theirs with `register`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "narration_plan"


def register(name: str, sql: str | None = None):
    """Add a query under a name; `sql` gives the same rows and columns in DuckDB."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
