"""Named queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, tables) -> DataFrame under its name, with the SQL that must agree with it.

    tables is a Tables: attribute access reads one of the driver's tables.
    """

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(spark, Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


class Tables:
    """The Parquet tables below one folder; a table is read when it is named."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(self.path(name))
