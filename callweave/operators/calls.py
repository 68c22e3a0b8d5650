"""Tabular calls: from stored rows to the columns that clustering and aggregation use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.config import MergeConfig


def clusterable(rows: DataFrame, cfg: MergeConfig | None = None) -> DataFrame:
    """One row per call with a place: (idx, block, start, end, ...).

    Fully repeated rows (same ``call_id``) count once; calls without contig or start can't be placed and are left
    out; a missing length counts as the stored second coordinate.  ``block`` is contig and bucket class.
    """
    cfg = cfg or MergeConfig()
    length = F.coalesce(F.col("svlen"), F.col("end_pos"))
    spans = F.col("variant_type").isin("DEL", "INV", "DUP", "CNV")
    once = rows.filter(F.col("contig").isNotNull() & F.col("start_pos").isNotNull() & F.col("variant_type").isin(*cfg.svtype)).dropDuplicates(["call_id"])
    if cfg.contig:
        once = once.filter(F.col("contig").isin(*cfg.contig))
    if not cfg.keep_monomorphic:
        once = once.filter(F.col("support_mask") != 0)
    if cfg.filter_tr_contained:
        once = once.filter(F.col("trid").isNull())
    return once.select(
        F.col("call_id").alias("idx"),
        F.concat_ws(":", "contig", "variant_type").alias("block"),
        "contig",
        F.col("variant_type").alias("bucket"),
        F.coalesce("svtype", "variant_type").alias("svtype"),
        "id",
        "sample_id",
        F.col("start_pos").alias("start"),
        F.col("end_pos").alias("end"),
        length.alias("svlen"),
        F.coalesce("start_mean", F.col("start_pos") + 1).alias("start_mean"),
        F.coalesce("start_variance", F.lit(0.0)).alias("start_variance"),
        F.coalesce("svlen_mean", length).alias("svlen_mean"),
        F.coalesce("svlen_variance", F.lit(0.0)).alias("svlen_variance"),
        F.array("support_mask").alias("support_mask"),
        F.coalesce("support_calls", F.lit(1)).alias("support_calls"),
        "max_dist",
        F.coalesce("info_hash", F.lit(0)).alias("info_hash"),
        "id_list",
        "trid",
        "svclaim",
        F.when(spans, F.col("start_pos")).alias("interval_start"),
        F.when(spans, F.col("start_pos") + F.abs(length)).alias("interval_end"),
        F.lit(0).alias("motif_len"),
    )


def merge_radius(svlen, cfg: MergeConfig):
    """How far a call may lie from another: a share of its length, not below the least distance, or fixed."""
    if not cfg.linear:
        return F.lit(float(cfg.max_dist))
    share = F.lit(float(cfg.max_dist_linear)) * F.abs(svlen)
    return share if cfg.min_dist == -1 else F.greatest(share, F.lit(float(cfg.min_dist)))


def in_regions(df: DataFrame, regions: list[tuple[str, int, int | None]], contig: str = "contig", pos0: str = "pos0") -> DataFrame:
    """Rows whose position lies in some region (contig, first, last); last is included, null is open."""
    if not regions:
        return df
    tests = [(F.col(contig) == c) & (F.col(pos0) >= a) & (F.lit(True) if b is None else F.col(pos0) <= b) for c, a, b in regions]
    return df.filter(reduce(lambda x, y: x | y, tests))
