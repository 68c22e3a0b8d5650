"""Predicates over a pair of calls, as columns over two sides of a join.

A side is a function from a column name to the column; ``side("a_")`` reads the columns prefixed so.
Single-precision settings are compared the way they were set: as 32-bit floats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.config import EPSILON, MergeConfig
from callweave.functions import masks
from callweave.functions.scalars import rotated, round_half_up

Side = Callable[[str], Column]


def side(prefix: str) -> Side:
    return lambda name: F.col(prefix + name)


def _single(x: float) -> Column:
    return F.lit(x).cast("float")


def distance(a: Side, b: Side) -> Column:
    return F.sqrt(F.pow(a("start") - b("start"), 2) + F.pow(a("end") - b("end"), 2))


def same_repeat(a: Side, b: Side) -> Column:
    return F.coalesce(a("trid") == b("trid"), F.lit(False))


def repeat_conflict(a: Side, b: Side) -> Column:
    """Both lie in repeats, and in different ones."""
    return F.coalesce(a("trid") != b("trid"), F.lit(False))


def pair_limit(a: Side, b: Side, cfg: MergeConfig) -> Column:
    """The distance up to which two calls may match."""
    pick = F.greatest if cfg.no_mutual_distance else F.least
    return F.when(same_repeat(a, b), F.lit(float(cfg.tr_max_dist))).otherwise(pick(a("max_dist"), b("max_dist")))


def reach(call: Side, cfg: MergeConfig) -> Column:
    """How far a call looks for partners."""
    return F.when(call("trid").isNotNull(), F.greatest(call("max_dist"), F.lit(float(cfg.tr_max_dist)))).otherwise(call("max_dist"))


def share_sample(a: Side, b: Side) -> Column:
    return masks.shared(a("support_mask"), b("support_mask"))


def size_similarity(a: Side, b: Side) -> Column:
    x, y = F.abs(a("svlen")), F.abs(b("svlen"))
    both_zero = (x <= EPSILON) & (y <= EPSILON)
    p, q = F.when(x <= EPSILON, F.lit(1.0)).otherwise(x), F.when(y <= EPSILON, F.lit(1.0)).otherwise(y)
    return F.when(both_zero, F.lit(1.0)).otherwise(F.least(p, q) / F.greatest(p, q))


def sizes_match(a: Side, b: Side, least: float) -> Column:
    return F.lit(True) if least <= EPSILON else F.coalesce(size_similarity(a, b) >= F.lit(least - EPSILON), F.lit(True))


def text_similar(s: Column, t: Column, least: Column) -> Column:
    """Edit similarity of two sequences reaches ``least``; a length ratio below it decides without alignment."""
    long, short = F.greatest(F.length(s), F.length(t)), F.least(F.length(s), F.length(t))
    ratio = short.cast("float") / long.cast("float")
    score = (F.lit(1).cast("float") - (F.levenshtein(s, t).cast("float") / long.cast("float")).cast("float")).cast("float")
    return F.when(long == 0, least <= F.lit(EPSILON)).when(ratio.cast("float") < least, F.lit(False)).otherwise(score >= least)


def sequences_match(a: Side, b: Side, cfg: MergeConfig) -> Column:
    """Sequence similarity; calls in one repeat have their own threshold and may match after rotation."""
    s, t = a("sequence"), b("sequence")
    least = F.when(same_repeat(a, b), _single(cfg.tr_min_sequence_similarity)).otherwise(_single(cfg.min_sequence_similarity))
    period = F.least(a("motif_len"), b("motif_len")).cast("bigint")
    delta = round_half_up(a("start") - b("start")).cast("bigint")
    offset = F.when(period > 1, F.pmod(delta, period)).otherwise(F.lit(0).cast("bigint"))
    shifts = F.filter(F.array_distinct(F.array(delta, -delta, offset, -offset)), lambda x: x != 0)
    turned = F.exists(shifts, lambda x: text_similar(s, rotated(t, x), least) | text_similar(rotated(s, x), t, least))
    in_repeat = same_repeat(a, b) & (period > 0) & (a("svtype") == "INS") & (b("svtype") == "INS")
    return F.when(s.isNull() | t.isNull(), F.lit(True)).when(text_similar(s, t, least), F.lit(True)).when(in_repeat, turned).otherwise(F.lit(False))


def overlaps_match(a: Side, b: Side, least: Column) -> Column:
    """Reciprocal overlap; without an interval on either side it passes, without any overlap it fails."""
    shared = F.least(a("interval_end"), b("interval_end")) - F.greatest(a("interval_start"), b("interval_start"))
    longest = F.greatest(a("interval_end") - a("interval_start"), b("interval_end") - b("interval_start"))
    none = a("interval_start").isNull() | b("interval_start").isNull()
    return F.when(none, F.lit(True)).when(shared <= 0, F.lit(False)).otherwise(shared + F.lit(EPSILON) >= longest * least.cast("double"))


def sequences_pass(a: Side, b: Side, cfg: MergeConfig) -> Column:
    """``sequences_match``, but for calls of one sample that are let through."""
    return sequences_match(a, b, cfg) if cfg.allow_intrasample else F.when(share_sample(a, b), True).otherwise(sequences_match(a, b, cfg))


def pair_verdict(a: Side, b: Side, cfg: MergeConfig, sequences: bool = True) -> Column:
    """Whether two calls may match; cheap tests first, each reached only if those before it passed.

    Calls of one sample are let through without the dear tests where intra-sample matches are refused later anyway.
    Without ``sequences`` their test is left to ``sequences_pass``.
    """
    deferred = F.lit(False) if cfg.allow_intrasample else share_sample(a, b)
    overlap = F.when(same_repeat(a, b), _single(cfg.tr_min_recip_overlap)).otherwise(_single(cfg.min_reciprocal_overlap))
    rest = (
        F.when(~sizes_match(a, b, cfg.min_size_similarity), False)
        .when(~sequences_match(a, b, cfg) if sequences else F.lit(False), False)
        .otherwise(overlaps_match(a, b, overlap) if cfg.min_reciprocal_overlap > 0 else F.lit(True))
    )
    return F.when(repeat_conflict(a, b), False).when(distance(a, b) > pair_limit(a, b, cfg) + EPSILON, False).when(deferred, True).otherwise(rest)
