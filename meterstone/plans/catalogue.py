"""The queries of the metrics engine over the driver's tables, each beside the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import metric_queries, registry_queries, text_queries  # noqa: F401 (they note their queries down)
from .book import found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in found.items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.prom_counter(spark, sf_dir)
