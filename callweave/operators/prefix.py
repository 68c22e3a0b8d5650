"""Running aggregates over ordered groups of any size.

A window function sorts each group inside one task, so one group with a third of all rows stalls the job.
Here rows are range-partitioned by (keys, order), which cuts a large group into consecutive slices; each slice
is scanned by itself and receives what the slices before it add up to.  The carry table has one row for
each (group, slice) and is itself small per group: at most the number of partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.session import cut, shuffle_width

_KINDS = {"sum": F.sum, "max": F.max}
_JOIN = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
}


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    aggregates: dict[str, tuple[str, str]],
    *,
    exclusive: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Add running ``sum``/``max`` columns: ``aggregates`` maps output name to (kind, column).

    ``order`` must order the rows of a group totally.  ``exclusive`` leaves the row itself out; the first row
    then has null for ``max`` and 0 for ``sum``.  Null keys form a group of their own.  An empty input gives an
    empty output.
    """
    ranged = df.repartitionByRange(slices or shuffle_width(df.sparkSession), *keys, *order)
    ranged = cut(ranged.withColumn("_slice", F.spark_partition_id()))
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    inner = inner.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)

    totals = ranged.groupBy(*keys, "_slice").agg(
        *[_KINDS[kind](column).alias(f"_t_{name}") for name, (kind, column) in aggregates.items()]
    )
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_k_slice"),
        *[_KINDS[kind](f"_t_{name}").over(earlier).alias(f"_c_{name}") for name, (kind, _) in aggregates.items()],
    )
    scanned = ranged.select("*", *[_KINDS[kind](column).over(inner).alias(f"_w_{name}") for name, (kind, column) in aggregates.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_slice") == F.col("_k_slice")]
    joined = scanned.join(carry, reduce(lambda a, b: a & b, same), "left")
    return joined.select(
        *df.columns,
        *[_JOIN[kind](F.col(f"_c_{name}"), F.col(f"_w_{name}")).alias(name) for name, (kind, _) in aggregates.items()],
    )
