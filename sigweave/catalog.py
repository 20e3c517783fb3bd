"""All queries of the signalling engine with their SQL counterparts.

Every module of ``sigweave.queries`` gives (name, function, SQL or None); the SQL runs in DuckDB over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigweave.queries import analytics, correlation, details, evaluation, families, feedback, graphs, learning, normalization, rca, scoring, tables

_ALL = [q for module in (normalization, correlation, rca, families, scoring, details, analytics, graphs, learning, evaluation, feedback, tables) for q in module.QUERIES]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return rca.rca_distribution(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f, _ in _ALL}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _ALL if sql}
