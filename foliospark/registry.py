"""All queries of the document and bibliography engine, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import citing, documents, kernels, lookups, numbering, sections, texts, trees

PLANS = (numbering, citing, sections, texts, kernels, trees, lookups, documents)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citing.bibliography(spark, sf_dir)
