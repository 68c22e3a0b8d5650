"""Scalar rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two hashes.
_HASH_FACTOR, _HASH_PRIME = 17, 1_000_000_007
_FNV_OFFSET, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_hash(text: str | Column) -> Column:
    """Polynomial hash over the bytes of a text: h = (h * 17 + byte) mod 1000000007; null for null, 0 for empty."""
    digits = F.hex(F.encode(_col(text), "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    value = lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint")
    step = lambda h, i: (h * F.lit(_HASH_FACTOR) + value(i)) % F.lit(_HASH_PRIME)
    return F.when(_col(text).isNotNull(), F.aggregate(places, F.lit(0).cast("bigint"), step)).cast("int")


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a of some bytes (driver side: names and ids)."""
    return reduce(lambda h, b: ((h ^ b) * _FNV_PRIME) & 0xFFFFFFFFFFFFFFFF, data, _FNV_OFFSET)


def round_half_up(x: str | Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(_col(x) + F.lit(0.5))


def checked_int(x: str | Column, label: str) -> Column:
    """A 32-bit integer, or an error that names the field."""
    value = _col(x)
    outside = (value > 2147483647) | (value < -2147483648)
    return F.when(outside, F.raise_error(F.concat(F.lit(f"{label} does not fit 32 bits: "), value.cast("string"))).cast("int")).otherwise(value.cast("int"))


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(a1, b1) - F.greatest(a0, b0))


def dice(overlap: Column, length_a: Column, length_b: Column) -> Column:
    """Dice coefficient in millionths, rounded down."""
    return F.floor((F.lit(2) * overlap * F.lit(1_000_000)) / (length_a + length_b))


def distance_to_interval(point: Column, low: Column, high: Column) -> Column:
    """Distance from a point to a closed interval; 0 inside."""
    return F.greatest(low - point, point - high, F.lit(0).cast("bigint"))


def rotated(text: Column, shift: Column) -> Column:
    """A text rotated to the right; shifts of any sign and size wrap around; an empty text stays."""
    n = F.length(text)
    by = F.pmod(shift, n)
    return F.when(n == 0, text).otherwise(F.concat(F.right(text, by), F.left(text, n - by)))
