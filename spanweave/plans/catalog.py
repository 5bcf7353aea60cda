"""All core queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import details, hierarchies, predicates, relations, reports, structures, texts

PARTS = (hierarchies, texts, relations, structures, details, reports, predicates)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return hierarchies.p6_hierarchy(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
