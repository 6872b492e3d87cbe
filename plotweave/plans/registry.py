"""A registry of named queries with the SQL that DuckDB answers them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (table, spark) -> DataFrame, where table(name) reads a test table."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark)

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add
