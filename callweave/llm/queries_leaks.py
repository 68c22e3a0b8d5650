"""p8: evaluation passages inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.leaks import leaks
from callweave.llm.registry import query
from callweave.session import table


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@query("p8_found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


@query("p8_items")
def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which items leaked: the number of documents, the longest tile and the greatest coverage."""
    per_item = _leaks(spark, folder).groupBy("item_id")
    return per_item.agg(F.count("*").alias("n_docs"), F.max("longest").alias("longest"), F.max("coverage").alias("coverage"))
