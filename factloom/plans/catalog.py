"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import arrivals, facts, filling, matching, scans, texts  # noqa: F401
from factloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["extracted_and_elected"](spark, folder)
