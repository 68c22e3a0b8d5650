"""The similarity self-join: candidate pairs of calls of one block within reach of each other.

Calls are binned in both coordinates at the power of two that covers their reach.  A call looks into the nine bins around
it at its own level; a partner stands in one bin at each level at or above its own.  A few calls with a huge reach thus cost
a few rows, not a coarse grid for all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.config import EPSILON, MergeConfig
from callweave.functions.masks import as_words
from callweave.functions.predicates import distance, pair_verdict, reach, sequences_pass, share_sample, side

_COLUMNS = ["idx", "start", "end", "svlen", "svtype", "max_dist", "support_mask", "trid", "motif_len", "interval_start", "interval_end"]


def candidate_pairs(calls: DataFrame, cfg: MergeConfig) -> DataFrame:
    """(block, a, b, dist, a_asks, b_asks): unordered pairs a < b that pass all tests, and who has whom in reach.

    Sequences stay out of the bins: pairs that pass all other tests fetch theirs by ``idx`` (unique), and only if the
    table has a ``sequence`` column.
    """
    calls = as_words(calls)
    near = calls.select("block", *_COLUMNS).withColumn("_reach", reach(F.col, cfg) + F.lit(EPSILON))
    near = near.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("_reach", F.lit(1.0))))).cast("int"))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("bigint")
    around = F.array(*[F.lit(i).cast("bigint") for i in (-1, 0, 1)])
    asking = near.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    asking = asking.withColumn("_x", at("start") + F.col("_dx")).withColumn("_y", at("end") + F.col("_dy")).drop("_dx", "_dy")
    levels = near.groupBy("block").agg(F.collect_set("_level").alias("_levels"))  # some tens of levels at most
    standing = near.withColumnRenamed("_level", "_own").join(levels, "block").withColumn("_level", F.explode(F.filter("_levels", lambda v: v >= F.col("_own"))))
    standing = standing.withColumn("_x", at("start")).withColumn("_y", at("end")).drop("_levels")
    p = asking.select("block", "_level", "_x", "_y", *[F.col(c).alias(f"p_{c}") for c in [*_COLUMNS, "_reach"]])
    q = standing.select("block", "_level", "_x", "_y", "_own", *[F.col(c).alias(f"q_{c}") for c in [*_COLUMNS, "_reach"]])
    joined = p.join(q, ["block", "_level", "_x", "_y"]).filter(
        (F.col("p_idx") != F.col("q_idx")) & ((F.col("_own") < F.col("_level")) | (F.col("p_idx") < F.col("q_idx")))
    )
    a, b = side("p_"), side("q_")
    joined = joined.withColumn("dist", distance(a, b)).filter((F.col("dist") <= F.greatest("p__reach", "q__reach")) & pair_verdict(a, b, cfg, sequences=False))
    if "sequence" in calls.columns:
        texts = calls.filter(F.col("sequence").isNotNull()).select("idx", "sequence")
        for s in ("p", "q"):
            joined = joined.join(texts.select(F.col("idx").alias(f"{s}_idx"), F.col("sequence").alias(f"{s}_sequence")), f"{s}_idx", "left")
        joined = joined.filter(sequences_pass(a, b, cfg))
    turn = F.col("p_idx") > F.col("q_idx")
    asks = lambda s: F.col("dist") <= F.col(f"{s}__reach")
    return joined.select(
        "block",
        F.least("p_idx", "q_idx").alias("a"),
        F.greatest("p_idx", "q_idx").alias("b"),
        "dist",
        F.when(turn, asks("q")).otherwise(asks("p")).alias("a_asks"),
        F.when(turn, asks("p")).otherwise(asks("q")).alias("b_asks"),
        share_sample(a, b).alias("same_sample"),
    )


def nearest_partners(pairs: DataFrame, k: int) -> DataFrame:
    """(u, v, rank): the k nearest of each call's partners, ties by index; the rank filter runs before the shuffle."""
    half = lambda u, v: pairs.select(F.col(u).alias("u"), F.col(v).alias("v"), "dist")
    rank = F.row_number().over(Window.partitionBy("u").orderBy("dist", "v"))
    return half("a", "b").unionByName(half("b", "a")).withColumn("rank", rank).filter(F.col("rank") <= k).select("u", "v", "rank")
