"""Diagnostics of a merge as one wide table: plane points, cluster members, cluster sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.aggregate import group_sizes

_COLUMNS = ("record_type", "block", "idx", "group_id", "id", "svtype", "start", "end", "svlen", "max_dist", "sample_id", "support_mask", "trid", "group_size", "n_groups", "support_calls")


def diagnostics(calls: DataFrame, membership: DataFrame) -> DataFrame:
    """16 text columns; tabs and line breaks inside values become blanks."""

    def shape(df: DataFrame, kind: str) -> DataFrame:
        kinds = dict(df.dtypes)
        value = lambda c: F.array_join(F.col(c).cast("array<string>"), ",") if kinds[c].startswith("array") else F.col(c).cast("string")
        clean = lambda c: F.regexp_replace(value(c), "[\t\r\n]", " ")
        own = [clean(c).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in _COLUMNS[1:]]
        return df.select(F.lit(kind).alias("record_type"), *own)

    members = calls.join(membership, ["block", "idx"])
    sizes = group_sizes(membership).withColumnRenamed("size", "group_size")
    return shape(calls, "kd_coord").unionByName(shape(members, "group_variant")).unionByName(shape(sizes, "group_size_count"))


def write_tsv(table: DataFrame, folder: str) -> None:
    table.write.option("header", True).option("sep", "\t").csv(folder)
