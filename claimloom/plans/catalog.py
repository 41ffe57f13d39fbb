"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimloom.plans import claim_queries, claim_sql, core_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core_queries.QUERIES | claim_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return core_queries.ORACLE | claim_sql.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_queries.candidate_disputes(spark, sf_dir)
