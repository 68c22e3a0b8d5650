"""References to records that do not exist, are deleted, or arrive only later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.operators.prefix import prefix_scan
from callweave.session import cut

#: A parent table of at most so many rows, with at most so many to a key, is sent to all tasks; beyond, everything is shuffled.
SMALL_PARENT, SMALL_KEY = 10_000, 32
_ALWAYS, _NEVER = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def _moment(column: str, otherwise: str) -> Column:
    return F.coalesce(F.col(column).cast("timestamp_ntz"), F.lit(otherwise).cast("timestamp_ntz"))


def broken_references(
    children: DataFrame,
    foreign_key: list[str],
    child_time: str,
    parents: DataFrame,
    parent_key: list[str],
    parent_from: str,
    parent_until: str,
    keep: list[str],
    real: Column | None = None,
) -> DataFrame:
    """Rows of ``children`` whose reference has no target valid at ``child_time``, with a ``status``.

    A parent row is valid from ``parent_from`` (that instant included) until ``parent_until`` (excluded; null: for
    ever).  ``missing``: no parent row has the key.  ``late``: some parent row starts after the child's time.
    ``deleted``: there are parent rows, all over.  A reference is a child row whose key columns are all
    non-null and for which ``real`` holds; in a key of several columns a null makes no reference unless it stands in
    a leading (scope) column, where it matches nothing.  A null ``parent_from`` means always, a null
    ``child_time`` means the latest moment.  All child rows count, repeated ones as often as they occur; empty
    tables give an empty result or all ``missing``.

    Plan: distinct (key, time) pairs are anti-joined with the parent keys; what remains is decided by a running count of
    open targets, which splits hot keys over tasks; rows are joined back last, with broken pairs only.  A parent table that is counted
    and found small goes to all tasks instead, and child rows are judged where they are.
    """
    k = [f"_k{i}" for i in range(len(foreign_key))]
    last = foreign_key[-1]
    refs = children.filter(F.col(last).isNotNull() & (F.lit(True) if real is None else real)).select(
        *keep,
        *[F.col(c).alias(a) for c, a in zip(foreign_key, k)],
        _moment(child_time, _NEVER).alias("_t"),
    )
    targets = parents.select(
        *[F.col(c).alias(a) for c, a in zip(parent_key, k)],
        _moment(parent_from, _ALWAYS).alias("_from"),
        _moment(parent_until, _NEVER).alias("_until"),
    ).dropna(subset=k)
    if targets.limit(SMALL_PARENT + 1).count() <= SMALL_PARENT:
        per_key = targets.groupBy(*k).agg(F.collect_list(F.struct("_from", "_until")).alias("_all"))
        if per_key.filter(F.size("_all") > SMALL_KEY).isEmpty():
            return _judged(refs, per_key, k, keep)
    # Each side is scanned once here and kept as distinct (key, time): all decisions are made on these.
    asked = cut(refs.select(*k, "_t").distinct())
    starts = F.struct(F.col("_from").alias("_t"), (F.col("_until") > F.col("_from")).cast("int").alias("_d"), F.col("_from").alias("_start"))
    ends = F.struct(F.col("_until").alias("_t"), F.lit(-1).alias("_d"), F.lit(None).cast("timestamp_ntz").alias("_start"))
    moments = F.when(F.col("_until") > F.col("_from"), F.array(starts, ends)).otherwise(F.array(starts))
    changes = targets.select(*k, F.explode(moments).alias("_e")).groupBy(*k, "_e._t").agg(F.sum("_e._d").alias("_d"), F.max("_e._start").alias("_start"))
    changes = cut(changes.join(asked.select(*k).distinct(), k, "left_semi"))
    spans = changes.groupBy(*k).agg(F.max("_start").alias("_latest"))

    missing = asked.join(spans, [asked[c].eqNullSafe(spans[c]) for c in k], "left_anti").select(*k, "_t", F.lit("missing").alias("status"))
    known = asked.join(spans.select(*k), k, "left_semi").select(*k, "_t", F.lit(0).cast("bigint").alias("_d"), F.lit(1).alias("_asked"))
    events = changes.select(*k, "_t", "_d", F.lit(0).alias("_asked")).unionByName(known).groupBy(*k, "_t").agg(F.sum("_d").alias("_d"), F.max("_asked").alias("_asked"))
    running = prefix_scan(events, k, ["_t"], {"_open": ("sum", "_d")})
    invalid = running.filter((F.col("_asked") == 1) & (F.col("_open") <= 0)).join(spans, k)
    timed = invalid.select(*k, "_t", F.when(F.col("_latest") > F.col("_t"), "late").otherwise("deleted").alias("status"))

    broken = missing.unionByName(timed).select(*[F.col(c).alias(f"_b{c}") for c in [*k, "_t"]], "status")
    same = [F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in [*k, "_t"]]
    return refs.join(broken, reduce(lambda x, y: x & y, same)).select(*keep, "status")


def _judged(refs: DataFrame, per_key: DataFrame, k: list[str], keep: list[str]) -> DataFrame:
    """Broken references against few targets, sent to all tasks: (kept columns, status)."""
    judged = refs.join(F.broadcast(per_key), k, "left")
    at = F.col("_t")
    fine = F.exists("_all", lambda x: (x["_from"] <= at) & (x["_until"] > at))
    status = F.when(F.col("_all").isNull(), "missing").when(fine, F.lit(None)).when(F.exists("_all", lambda x: x["_from"] > at), "late").otherwise("deleted")
    return judged.select(*keep, status.alias("status")).filter(F.col("status").isNotNull())


def breakend_references(breakends: DataFrame, contigs: DataFrame) -> DataFrame:
    """Broken ``mate_id`` and ``mate_contig`` references: (rec_id, loaded_at, field_name, status)."""
    keep = ["rec_id", "loaded_at"]
    mates = broken_references(
        breakends, ["vcf_id", "mate_id"], "loaded_at", breakends, ["vcf_id", "id"], "loaded_at", "deleted_at", keep, F.col("mate_id") != "."
    )
    places = broken_references(breakends, ["mate_contig"], "loaded_at", contigs, ["contig"], "added_at", "retired_at", keep)
    label = lambda df, name: df.select(*keep, F.lit(name).alias("field_name"), "status")
    return label(mates, "mate_id").unionByName(label(places, "mate_contig"))


def reference_counts(broken: DataFrame, table_name: str) -> DataFrame:
    """Broken references per table, field, state and calendar month of ``loaded_at``."""
    month = F.date_format(F.date_trunc("month", "loaded_at"), "yyyy-MM").alias("period")
    return broken.groupBy(F.lit(table_name).alias("table_name"), "field_name", month, "status").agg(F.count("*").alias("n_refs"))
