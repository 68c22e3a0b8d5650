"""Breakend notation: bracketed ALT alleles, strands, plane coordinates, block keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACE = r"[\[\]](.+):(\d+)[\[\]]"


def mate_contig(alt: Column) -> Column:
    """The contig of a bracketed ALT, up to its last colon; null if the ALT is no breakend."""
    found = F.regexp_extract(alt, _PLACE, 1)
    return F.when(found != "", found)


def mate_pos0(alt: Column) -> Column:
    """The zero-based mate position; positions start at 1, others are an error."""
    found = F.regexp_extract(alt, _PLACE, 2)
    pos = F.when(found != "", found.try_cast("bigint"))
    return F.when(pos < 1, F.raise_error(F.lit("breakend position below 1")).cast("bigint")).otherwise(pos - 1)


def anchor(alt: Column) -> Column:
    """The bases outside the brackets of an ALT; none is an error."""
    found = F.regexp_replace(alt, r"[\[\]].*[\[\]]", "")
    return F.when(found == "", F.raise_error(F.concat(F.lit("no anchor in "), alt)).cast("string")).otherwise(found)


def strands(alt: Column, given: Column | None = None) -> Column:
    """Orientation from the brackets; a given two-letter value wins."""
    inferred = (
        F.when(alt.startswith("["), "+-").when(alt.startswith("]"), "--").when(F.contains(alt, F.lit("[")), "++").when(F.contains(alt, F.lit("]")), "-+")
    )
    return inferred if given is None else F.when(F.length(given) == 2, given).otherwise(inferred)


def swapped(contig: Column, pos0: Column, other: Column, other_pos0: Column) -> Column:
    return (contig > other) | ((contig == other) & (pos0 > other_pos0))


def plane_point(contig: Column, pos0: Column, other: Column, other_pos0: Column, mean_a: Column | None = None, mean_b: Column | None = None) -> Column:
    """(first, second) coordinate of a breakend: canonical order of its two places; given averages win."""
    first = pos0.cast("double") if mean_a is None else F.coalesce(mean_a - 1, pos0.cast("double"))
    second = other_pos0.cast("double") if mean_b is None else F.coalesce(mean_b - 1, other_pos0.cast("double"))
    turn = swapped(contig, pos0, other, other_pos0)
    return F.struct(F.when(turn, second).otherwise(first).alias("start"), F.when(turn, first).otherwise(second).alias("end"))


def block_key(a_contig: Column, b_contig: Column, a_strands: Column, b_strands: Column) -> Column:
    return F.concat_ws("_", a_contig, b_contig, F.lit("TRA"), a_strands, b_strands)


def alt_allele(contig: Column, pos1: Column, orientation: Column, anchor: Column) -> Column:
    """The bracketed ALT of a breakend; an unknown orientation is an error."""
    place = F.concat(contig, F.lit(":"), pos1.cast("string"))
    wrap = lambda b: F.concat(F.lit(b), place, F.lit(b))
    return (
        F.when(orientation == "+-", F.concat(wrap("["), anchor))
        .when(orientation == "--", F.concat(wrap("]"), anchor))
        .when(orientation == "++", F.concat(anchor, wrap("[")))
        .when(orientation == "-+", F.concat(anchor, wrap("]")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown orientation "), F.coalesce(orientation, F.lit("null")))).cast("string"))
    )
