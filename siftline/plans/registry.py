"""Registered queries: a name, a plan over the given tables, and its ANSI SQL when there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy parquet scans of one data folder; each use is its own pruned scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self._folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, tables)`` under a name."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(spark, Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap
