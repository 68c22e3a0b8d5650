"""p6: records whose alleles are nearly the same sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callweave.llm.edits import near_records, record_links
from callweave.llm.registry import query
from callweave.session import table


@query("p6_found")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_records(table(spark, folder, "write_records"), "rec_id", "alleles")


@query("p6_links")
def p6_links(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record with its class of exact copies and the number of near records."""
    return record_links(table(spark, folder, "write_records"), "rec_id", "alleles")
