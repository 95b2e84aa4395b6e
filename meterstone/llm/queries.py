"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate,
    exact_dedup,
    html_extract,
    license_scan,
    packing,
    passages,
    simhash,
    toxicity,
    url_filter,
    warc,
)

HOST_RULES = (
    url_filter.HostRule("allow", "com", "/"),
    url_filter.HostRule("block", "example.com", "/en/"),
    url_filter.HostRule("allow", "www.example.com", "/en/"),
    url_filter.HostRule("block", "net", "/es/"),
    url_filter.HostRule("block", "net", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), HOST_RULES)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("payload")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        op1_html_extract, op2_repeated_passages, op3_url_filter, op4_exact_dedup, op5_packing, op6_decontaminate, op7_warc,
        op8_license_scan, op9_toxicity, op10_simhash,
    )
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": url_filter.filter_urls_sql(HOST_RULES), "op4_exact_dedup": exact_dedup.EXACT_GROUPS_SQL,
        "op7_warc": warc.ROUND_TRIP_SQL, "op8_license_scan": license_scan.scan_sql(),
    }
