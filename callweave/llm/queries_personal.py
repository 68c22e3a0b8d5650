"""p9: personal data in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callweave.llm.personal import personal_spans, redacted
from callweave.llm.registry import query
from callweave.session import table


@query("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_spans(table(spark, folder, "documents"))


@query("p9_redacted")
def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts with a placeholder for each passage."""
    return redacted(table(spark, folder, "documents"))
