"""All queries of the library's own operators, gathered from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillflow.queries import domain, joins, reducers, rows, scalars, stored, streams  # noqa: F401
from rillflow.queries.registry import FOUND, Tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.flagship(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
