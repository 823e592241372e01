"""All queries of the core with their SQL equivalents, collected from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    from tideline.plans import cleaning, clusters, evaluation, files, ml, profiling, relations, retrieval, series, streams, virality

    return profiling, cleaning, series, clusters, relations, retrieval, virality, evaluation, ml, streams, files


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in _modules():
        out.update(m.PLANS.queries)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out.update(m.PLANS.sql)
    return out


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Daily activity per event type with trailing z-scores."""
    from tideline.plans import series

    return series.wn01_z_daily_scored(spark, folder)
