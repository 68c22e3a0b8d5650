"""Merged records: what a cluster of calls adds up to.

The mergeable state is (support, weighted mean, weighted variance, ids, claims, mask), so merged records can be merged again.
Variances are taken around the mean in a second pass, never as a difference of large sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.config import MergeConfig
from callweave.functions import masks
from callweave.functions.masks import as_words
from callweave.functions.scalars import checked_int, round_half_up

_SPANNING = ("DEL", "DUP", "INV", "CNV")
_Z = 1.96


def _keyed(members: DataFrame) -> DataFrame:
    members = as_words(members)
    return members.withColumn("first_sample", masks.first(F.col("support_mask")))


def _representative() -> Column:
    return F.min(F.struct("first_sample", "id", "idx", "start"))


def _repeat() -> Column:
    return F.min(F.when(F.col("trid").isNotNull(), F.struct("first_sample", "id", "idx", "trid")))


def representatives(members: DataFrame) -> DataFrame:
    """The first member of each cluster in member order, found by an aggregate that combines before the shuffle."""
    best = _keyed(members).groupBy("block", "group_id").agg(_representative().alias("_b"))
    return best.select("block", "group_id", F.col("_b.idx").alias("rep_idx"), F.col("_b.id").alias("rep_id"), (F.col("_b.start") + 1).cast("bigint").alias("pos"))


def _support(words: int) -> list[Column]:
    return [
        masks.union_size("support_mask", words).alias("supp"),
        F.sum("support_calls").alias("supp_calls"),
        F.sort_array(F.flatten(F.collect_list("id_list"))).alias("ids"),
        F.count("*").alias("n_calls"),
    ]


def support(members: DataFrame, words: int = 1) -> DataFrame:
    """SUPP, SUPP_CALLS and the sorted id list (repeats kept) of each cluster; masks have ``words`` words."""
    return as_words(members).groupBy("block", "group_id").agg(*_support(words))


def _mean(column: str) -> Column:
    w = F.col("support_calls").cast("double")
    return F.sum(w * F.col(column)) / F.sum(w)


def _spread(mean: str, variance: str) -> Column:
    w = F.col("support_calls").cast("double")
    return F.sum(w * (F.col(variance) + F.pow(F.col(mean) - F.col(f"{mean}_of"), 2))) / F.sum(w)


def moments(members: DataFrame) -> DataFrame:
    """Support-weighted means and total variances of start and length, in two passes."""
    keys = ["block", "group_id"]
    means = members.groupBy(*keys).agg(_mean("start_mean").alias("start_mean_of"), _mean("svlen_mean").alias("svlen_mean_of"))
    return members.join(means, keys).groupBy(*keys).agg(
        F.first("start_mean_of").alias("mean_start"),
        F.first("svlen_mean_of").alias("mean_svlen"),
        _spread("start_mean", "start_variance").alias("var_start"),
        _spread("svlen_mean", "svlen_variance").alias("var_svlen"),
    )


def interval_offsets(mean: Column, variance: Column, anchor: Column) -> tuple[Column, Column]:
    half = F.lit(_Z) * F.sqrt(variance)
    return round_half_up(mean - half) - anchor, round_half_up(mean + half) - anchor


def _claims() -> list[Column]:
    return [F.sort_array(F.collect_set("svclaim")).alias("_set"), F.count("svclaim").alias("_c")]


def _claim_columns() -> list[Column]:
    one = (F.col("_k") != "CNV") & (F.size("_set") == 1) & (F.col("n_calls") == F.col("_c"))
    known = F.col("_k").isin("DEL", "DUP", "CNV")
    return [F.when(known & one, F.col("_set")[0]).alias("svclaim"), F.when(known & ~one & (F.size("_set") > 0), F.col("_set")).alias("svclaim_set")]


def claims(members: DataFrame) -> DataFrame:
    """SVCLAIM if all members of a DEL or DUP cluster make the same claim, else the sorted set; CNV always has the set."""
    grouped = members.filter(F.col("bucket").isin("DEL", "DUP", "CNV")).groupBy("block", "group_id")
    return grouped.agg(*_claims(), F.count("*").alias("n_calls"), F.first("bucket").alias("_k")).select("block", "group_id", *_claim_columns())


def repeat_of_cluster(members: DataFrame) -> DataFrame:
    """The repeat of the first member, in member order, that lies in one."""
    best = _keyed(members.filter(F.col("trid").isNotNull())).groupBy("block", "group_id").agg(_repeat().alias("_b"))
    return best.select("block", "group_id", F.col("_b.trid").alias("tr_contained"))


def merged_records(members: DataFrame, cfg: MergeConfig, words: int = 1) -> DataFrame:
    """One record per cluster that has enough support; ``members`` are calls with their ``group_id``.

    Two passes by the same key: everything but the spread in the first, the spread around its means in the second.
    """
    keys = ["block", "group_id"]
    keyed = _keyed(members)
    first = keyed.groupBy(*keys).agg(
        _representative().alias("_b"), _repeat().alias("_t"), *_support(words), *_claims(), F.first("contig").alias("contig"), F.first("bucket").alias("_k"),
        _mean("start_mean").alias("start_mean_of"), _mean("svlen_mean").alias("svlen_mean_of"),
    )
    light = keyed.select(*keys, "support_calls", "start_mean", "start_variance", "svlen_mean", "svlen_variance")
    spread = light.join(first.select(*keys, "start_mean_of", "svlen_mean_of"), keys).groupBy(*keys)
    second = spread.agg(_spread("start_mean", "start_variance").alias("var_start"), _spread("svlen_mean", "svlen_variance").alias("var_svlen"))
    record = first.join(second, keys).withColumns({"svtype": F.col("_k"), "pos": (F.col("_b.start") + 1).cast("bigint"), "mean_start": F.col("start_mean_of"), "mean_svlen": F.col("svlen_mean_of")})
    keep = F.col("supp") >= cfg.min_supp
    record = record.filter(keep | ((F.col("supp") == 0) if cfg.keep_monomorphic else F.lit(False)))
    length = round_half_up(F.abs("mean_svlen"))
    spanning = F.col("svtype").isin(*_SPANNING)
    lo, hi = interval_offsets(F.col("mean_start"), F.col("var_start"), F.col("pos"))
    end = F.col("pos") + length
    e_lo, e_hi = interval_offsets(F.col("mean_start") + F.abs("mean_svlen"), F.col("var_start") + F.col("var_svlen"), end)
    return record.select(
        "contig",
        "pos",
        F.col("_b.id").alias("id"),
        "svtype",
        checked_int(F.when(F.col("svtype") == "DEL", -length).otherwise(length), "SVLEN").alias("svlen"),
        F.when(spanning, end).alias("end"),
        F.array(checked_int(lo, "CIPOS"), checked_int(hi, "CIPOS")).alias("cipos"),
        F.when(spanning, F.array(checked_int(e_lo, "CIEND"), checked_int(e_hi, "CIEND"))).alias("ciend"),
        "supp",
        "supp_calls",
        F.col("ids").alias("idlist"),
        *_claim_columns(),
        F.col("_t.trid").alias("tr_contained"),
        "block",
        "group_id",
        F.col("_b.idx").alias("rep_idx"),
    )


def group_sizes(membership: DataFrame) -> DataFrame:
    """How many clusters of each size a block has."""
    sizes = membership.groupBy("block", "group_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("block", "size").agg(F.count("*").alias("n_groups"))


def sample_cells(members: DataFrame) -> DataFrame:
    """Per cluster and output sample the member that speaks for it: the first supporting one in member order."""
    spread = _keyed(members).withColumn("sample", F.explode(masks.samples_of(F.col("support_mask"))))
    best = spread.groupBy("block", "group_id", "sample").agg(F.min(F.struct("first_sample", "id", "idx")).alias("_b"))
    return best.select("block", "group_id", "sample", F.col("_b.idx").alias("idx"))


def recombined(states: DataFrame, keys: list[str]) -> DataFrame:
    """Merged states merged again: (support_calls, mean, variance) by weights, in two passes that both combine before the shuffle."""
    means = states.groupBy(*keys).agg(_mean("mean").alias("mean_of"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = states.alias("l").join(means.alias("r"), reduce(lambda a, b: a & b, same)).select("l.*", "mean_of")
    return both.groupBy(*keys).agg(F.sum("support_calls").alias("support_calls"), F.first("mean_of").alias("mean"), _spread("mean", "variance").alias("variance"))
