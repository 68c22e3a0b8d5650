"""Fields of call records: INFO values, FILTER membership, sample-prefixed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def info_map(info: Column) -> Column:
    """INFO text as a map; flags map to null, ``.`` gives an empty map; of a repeated key the first counts."""
    items = F.filter(F.split(F.coalesce(info, F.lit(".")), ";"), lambda x: (x != "") & (x != "."))
    keys = F.transform(items, lambda x: F.split(x, "=", 2)[0])
    first = F.filter(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(keys, F.split(s["x"], "=", 2)[0]) == s["i"] + 1)
    return F.map_from_entries(F.transform(first, lambda s: F.struct(F.split(s["x"], "=", 2)[0], F.get(F.split(s["x"], "=", 2), F.lit(1)))))


def values(info: Column, tag: str) -> Column:
    """All values of a tag without empty ones and ``.``; an empty array if the tag is absent."""
    return F.filter(F.split(F.coalesce(F.try_element_at(info, F.lit(tag)), F.lit("")), ","), lambda x: (x != "") & (x != "."))


def first_value(info: Column, tag: str) -> Column:
    return F.get(values(info, tag), F.lit(0))


def first_number(info: Column, tag: str) -> Column:
    return first_value(info, tag).try_cast("double")


def numbers(info: Column, tag: str) -> Column:
    return F.transform(values(info, tag), lambda x: x.try_cast("double"))


def has_filter(filters: Column, name: str) -> Column:
    """Exact membership in the FILTER list; ``.`` and null hold none."""
    return F.coalesce(F.array_contains(F.split(filters, ";"), name) & (filters != "."), F.lit(False))


def is_cnv_id(ident: Column) -> Column:
    """Whether the second colon-separated part of an id is CNV."""
    return F.coalesce(F.get(F.split(ident, ":"), F.lit(1)) == "CNV", F.lit(False))


def bucket_class(svtype: Column, ident: Column) -> Column:
    return F.when((svtype == "CNV") | is_cnv_id(ident), F.lit("CNV")).otherwise(svtype)


def output_id(ident: Column, vcf_id: Column, sample_map: Column | None = None) -> Column:
    """The id in the output: the file's ordinal as prefix, or, for an id that begins with the number of a sample of its file, the
    sample's number in the output in its place.  ``sample_map`` leads from "file:number" to the latter."""
    plain = F.concat_ws("_", vcf_id.cast("string"), ident)
    if sample_map is None:
        return plain
    local = F.regexp_extract(ident, r"^\+?(\d+)_", 1)
    mapped = F.try_element_at(sample_map, F.concat_ws(":", vcf_id.cast("string"), local.try_cast("bigint").cast("string")))
    return F.when((local != "") & mapped.isNotNull(), F.concat_ws("_", mapped.cast("string"), F.regexp_replace(ident, r"^[^_]*_", ""))).otherwise(plain)
