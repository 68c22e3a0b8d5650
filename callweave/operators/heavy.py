"""Per-key results when a few keys hold most rows.

Everything here is algebraic: each task folds its rows into one small state per key (Spark's partial hash
aggregation, which falls back to sorted spills when the table is full) and only those states are shuffled.
A key with a third of all rows thus costs its final task no more than the number of map tasks in states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Algebraic aggregates by key; null keys form groups of their own."""
    return df.groupBy(*keys).agg(*aggregates)


def per_key_distinct(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Exact distinct counts by key in two steps, so that the values of a heavy key spread over all tasks."""
    return df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count("*").alias(name))


def heavy_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Keys without nulls in the first column that hold more than ``share`` of all rows, with their counts.

    Rows with null keys count in the total; an empty table has no heavy key; ties at exactly ``share`` are out.
    There are fewer than 1 / ``share`` such keys whatever the size, so the result may be broadcast.
    """
    total = df.agg(F.count("*").alias("n"))
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return counts.filter(F.col(keys[0]).isNotNull() & (F.col("n_rows") > F.lit(share) * total.scalar()))
