"""p7: token ids of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.registry import query
from callweave.llm.tokens import encode_texts
from callweave.session import table


@query("p7_ids")
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")


@query("p7_use")
def p7_use(spark: SparkSession, folder: str) -> DataFrame:
    """How often each id occurs in the corpus, and in how many documents."""
    ids = encode_texts(table(spark, folder, "documents"), "doc_id", "text")
    once = ids.select(F.explode("ids").alias("token_id"), "doc_id").groupBy("token_id", "doc_id").agg(F.count("*").alias("_n"))
    return once.groupBy("token_id").agg(F.sum("_n").alias("n_uses"), F.count("*").alias("n_docs"))
