"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under a name, with SQL that gives the same rows."""

    def add(f):
        assert name not in QUERIES
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add
