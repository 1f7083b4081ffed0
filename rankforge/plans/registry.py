"""All core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankforge.plans import candidate_queries, detail_queries, evidence_queries, extra_queries, handoff_queries, record_queries, skew_queries, source_queries

MODULES = [skew_queries, record_queries, candidate_queries, evidence_queries, extra_queries, handoff_queries, detail_queries, source_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Share of right calls of the rank policy, method by method: search results, consensus, margins, policy, summary."""
    return candidate_queries.a_policy_summary(spark, d)
