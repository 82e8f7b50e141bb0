"""Named queries of the library's operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chronic, cohorts, control, inference, models, provenance, quality, records, responses, signals

PARTS = [chronic, cohorts, models, control, alignment, records, inference, responses, provenance, quality, signals]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronic.threshold_report(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
