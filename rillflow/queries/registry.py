"""How a query and its oracle are kept together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


class Tables:
    """The tables of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers ``f(tables)`` under its name, with the DuckDB SQL of the same rows."""

    def register(f: Callable[[Tables], DataFrame]):
        FOUND[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir))), sql
        return f

    return register
