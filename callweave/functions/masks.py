"""Sets of samples as arrays of 64-bit words: bit i of word w stands for sample 64 w + i, so there may be any number of samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = 2147483647


def words_for(samples: int) -> int:
    return max(1, -(-samples // 64))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def of_samples(samples: Column, words: int) -> Column:
    """The mask of an array of sample numbers; nulls and repeats are skipped, a number beyond the words is an error."""
    word = lambda w: F.aggregate(
        F.filter(samples, lambda i: (i >= 64 * w) & (i < 64 * w + 64)), F.lit(0).cast("bigint"), lambda m, i: m.bitwiseOR(_bit(i - 64 * w))
    )
    masks = F.array(*[word(w) for w in range(words)])
    outside = F.exists(samples, lambda i: (i < 0) | (i >= 64 * words))
    return F.when(outside, F.raise_error(F.lit(f"a sample is beyond the {words} words of the masks")).cast("array<bigint>")).otherwise(masks)


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).bitwiseOR(F.coalesce(y, F.lit(0))))


def shared(a: Column, b: Column) -> Column:
    """Whether two masks have a sample in common."""
    return F.exists(F.zip_with(a, b, lambda x, y: F.coalesce(x.bitwiseAND(y), F.lit(0).cast("bigint"))), lambda v: v != 0)


def empty(mask: Column) -> Column:
    return ~F.exists(mask, lambda v: v != 0)


def first(mask: Column) -> Column:
    """The smallest sample of a mask; an empty one sorts last."""
    low = lambda v: F.when(v == -(1 << 63), 63).otherwise(F.bit_count(F.bitwise_not(v).bitwiseAND(v - 1)))
    return F.coalesce(F.array_min(F.transform(mask, lambda v, w: F.when(v != 0, w * 64 + low(v)))), F.lit(_NONE)).cast("int")


def samples_of(mask: Column) -> Column:
    """The sample numbers of a mask, in order."""
    each = lambda v, w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(v, i) == 1), lambda i: w * 64 + i)
    return F.flatten(F.transform(mask, each))


def holds(mask: Column, sample: Column) -> Column:
    return F.coalesce(F.getbit(F.get(mask, F.floor(sample / 64).cast("int")), (sample % 64).cast("int")) == 1, F.lit(False))


def union_size(mask: str, words: int) -> Column:
    """An aggregate: how many samples the masks of a group have together; it combines before the shuffle."""
    parts = [F.bit_count(F.coalesce(F.bit_or(F.get(F.col(mask), F.lit(w))), F.lit(0).cast("bigint"))) for w in range(words)]
    return reduce(lambda a, b: a + b, parts).cast("bigint")


def as_words(df: DataFrame, column: str = "support_mask") -> DataFrame:
    """Tables that store one word get an array of one."""
    return df.withColumn(column, F.array(F.col(column))) if dict(df.dtypes)[column] == "bigint" else df
