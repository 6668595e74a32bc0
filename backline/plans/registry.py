"""Names of queries with their functions and DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .domain import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the domain tables as a query."""

    def register(plan: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(Domain(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return plan

    return register
