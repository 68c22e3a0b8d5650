"""Imports every module that registers queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callweave.plans import data_checks, reference_queries  # noqa: F401
from callweave.plans.registry import QUERIES


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["merged_records"](spark, folder)
