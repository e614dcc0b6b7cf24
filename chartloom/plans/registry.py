"""The queries over the reference operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartloom.plans import documents, sessions, whole

MODULES = (documents, sessions, whole)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.out_of_range_labs(spark, sf_dir)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Some statements hold inline tables that are worked out when asked for."""
    return {name: sql() if callable(sql) else sql for m in MODULES for name, sql in m.SQL.items()}
