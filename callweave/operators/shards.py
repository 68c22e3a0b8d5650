"""Independent shards: maximal runs of calls of a block whose reach intervals touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.config import EPSILON, MergeConfig
from callweave.functions.predicates import reach
from callweave.operators.prefix import prefix_scan


def independent_shards(calls: DataFrame, cfg: MergeConfig) -> DataFrame:
    """(block, idx, shard): no pair of calls in different shards of a block is within reach of each other.

    A call opens a shard if its interval begins right of all that went before.  Shards are numbered from 0 in each
    block.  Both scans split blocks of any size over tasks.
    """
    r = reach(F.col, cfg)
    spans = calls.select("block", "idx", (F.col("start") - r - EPSILON).alias("_l"), (F.col("start") + r + EPSILON).alias("_e"))
    order = ["_l", "_e", "idx"]
    seen = prefix_scan(spans, ["block"], order, {"_before": ("max", "_e")}, exclusive=True)
    opens = seen.withColumn("_new", F.when(F.col("_before").isNotNull() & (F.col("_l") > F.col("_before")), 1).otherwise(0))
    return prefix_scan(opens, ["block"], order, {"shard": ("sum", "_new")}).select("block", "idx", F.col("shard").cast("bigint").alias("shard"))


def coalesced(sizes: list[int], least: int) -> list[list[int]]:
    """Small shards appended to the ones that follow until they hold ``least``; a short rest joins the last.

    Only a matter of task size: clusters never cross shards.  Spark's own coalescing of partitions does this at run time.
    """
    out: list[list[int]] = []
    current: list[int] = []
    for i, size in enumerate(sizes):
        current.append(i)
        if sum(sizes[k] for k in current) >= max(1, least):
            out.append(current)
            current = []
    if current:
        if out:
            out[-1] += current
        else:
            out.append(current)
    return out
