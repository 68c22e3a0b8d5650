"""Call files: validation, headers, samples, raw records and the calls derived from them.

Headers are small and read on the driver; records are read as text by Spark in one scan, one row a line, with the file's ordinal.  Files
packed in blocks unpack with the gzip codec; such a file is one task, so many files mean many tasks.
"""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.config import MergeConfig
from callweave.functions import breakends as notation
from callweave.functions import info as fields
from callweave.functions import masks
from callweave.functions.scalars import text_hash
from callweave.operators.calls import in_regions, merge_radius
from callweave.sources import bcf
from callweave.sources.text import SourceError, regions

_FIXED = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]


@dataclass(frozen=True)
class Header:
    lines: tuple[str, ...]
    contigs: tuple[tuple[str, int | None], ...]
    samples: tuple[str, ...]


def validate(path: str) -> None:
    """Plain text, or gzip data packed in blocks; the content must begin like a call file (a byte order mark is fine)."""
    with open(path, "rb") as raw:
        head = raw.read(18)
        if head[:2] == b"\x1f\x8b":
            extra = len(head) >= 18 and head[3] & 4 and head[12:14] == b"BC" and struct.unpack("<H", head[14:16])[0] == 2
            if not extra:
                raise SourceError(f"{path} is plain gzip; pack it in blocks (bgzip)")
            raw.seek(0)
            head = gzip.open(raw).read(32)
        if head.startswith(b"BCF\x02"):
            return
        if not head.removeprefix(b"\xef\xbb\xbf").startswith(b"##fileformat=VCF"):
            raise SourceError(f"{path} is no call file")


def is_binary(path: str) -> bool:
    with open(path, "rb") as raw:
        if raw.read(2) != b"\x1f\x8b":
            return False
        raw.seek(0)
        return gzip.open(raw).read(4) == b"BCF\x02"


def _plain_lines(path: str) -> Iterator[str]:
    opener = gzip.open if path.endswith((".gz", ".bgz", ".gzip")) else open
    with opener(path, "rt", encoding="utf-8-sig") as file:
        for line in file:
            yield line.rstrip("\r\n")


def read_header(path: str) -> Header:
    lines = list(takewhile(lambda line: line.startswith("#"), bcf.text_lines(path) if is_binary(path) else _plain_lines(path)))
    if not lines or not lines[-1].startswith("#CHROM"):
        raise SourceError(f"{path} has no column line")
    columns = lines[-1].split("\t")
    if len(columns) < 10:
        raise SourceError(f"{path} has no samples")
    found = []
    for line in lines:
        if line.startswith("##contig=<"):
            name = re.search(r"[<,]ID=([^,>]+)", line)
            length = re.search(r"[<,]length=(\d+)", line)
            if name:
                found.append((name[1], int(length[1]) if length else None))
    return Header(tuple(lines), tuple(found), tuple(columns[9:]))


def declared_fields(headers: tuple[Header, ...] | list[Header]) -> list[str]:
    """The INFO, FILTER and FORMAT lines of all headers, each field as first declared."""
    seen: dict[tuple[str, str], str] = {}
    for header in headers:
        for line in header.lines:
            found = re.match(r"##(INFO|FILTER|FORMAT)=<(?:.*?,)?ID=([^,>]+)", line)
            if found:
                seen.setdefault((found[1], found[2]), re.sub(r",IDX=\d+", "", line))
    return list(seen.values())


def format_types(header: Header) -> dict[str, str]:
    """Declared types of FORMAT tags."""
    found = (re.match(r"##FORMAT=<(?:.*?,)?ID=([^,>]+).*?,Type=(\w+)", line) for line in header.lines)
    return {m[1]: m[2] for m in found if m}


def contig_order(headers: list[Header]) -> dict[str, int | None]:
    """Contigs in the order first seen, with their lengths; two known lengths that differ are an error."""
    out: dict[str, int | None] = {}
    for header in headers:
        for name, length in header.contigs:
            if out.get(name) is not None and length is not None and out[name] != length:
                raise SourceError(f"contig {name} has lengths {out[name]} and {length}")
            out[name] = length if out.get(name) is None else out[name]
    return out


def sample_index(headers: list[Header]) -> dict[tuple[int, int], int]:
    """(file, place in file) to place in the output; a sample name in two files is an error."""
    names = [s for h in headers for s in h.samples]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise SourceError(f"sample names occur twice: {sorted(twice)}")
    places = [(f, i) for f, h in enumerate(headers) for i in range(len(h.samples))]
    return {p: k for k, p in enumerate(places)}


def raw_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Record lines of all files in one scan: (vcf_id, line_no order key, the nine fixed columns, samples).

    ``line_no`` grows with the place in the file: where the line's split begins, plus its row within the task; lines are longer than a byte,
    so no split reaches into the next one's numbers.
    """
    binary = {i for i, p in enumerate(paths) if is_binary(p)}
    plain = {i: p for i, p in enumerate(paths) if i not in binary}
    parts = []
    if plain:
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        text = spark.read.text(list(plain.values())).select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_p"), (F.col("_metadata.file_block_start") + row).alias("line_no"), "value")
        listed = spark.createDataFrame([(_uri(spark, p), i) for i, p in plain.items()], "_p string, vcf_id int")
        known = F.when(F.col("vcf_id").isNull(), F.raise_error(F.concat(F.lit("a file was read that isn't listed: "), "_p")).cast("int")).otherwise(F.col("vcf_id"))
        parts.append(text.join(listed, "_p", "left").select(known.alias("vcf_id"), "line_no", "value"))
    if binary:
        parts.append(bcf.binary_lines(spark, {i: paths[i] for i in sorted(binary)}))
    lines = reduce(DataFrame.unionByName, parts).filter(~F.col("value").startswith("#") & (F.trim("value") != "") & ~F.col("value").startswith("\ufeff#"))
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    fixed = [F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(_FIXED)]
    return lines.select("vcf_id", "line_no", *fixed, F.slice(cells, 10, F.greatest(F.size(cells) - 9, F.lit(0))).alias("samples")).withColumn("pos", F.col("pos").cast("bigint"))


def _uri(spark: SparkSession, path: str) -> str:
    """A path as the scan names it."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    whole = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(found).getPath()
    return re.sub("^file:/+", "file:/", whole.toUri().toString())


def row_index(vcf_id: Column, line_no: Column) -> Column:
    """A number that orders records by file and place and is unique over all files: 16 bits and 47."""
    outside = (vcf_id >= 1 << 16) | (line_no >= 1 << 47)
    number = F.call_function("shiftleft", vcf_id.cast("bigint"), F.lit(47)).bitwiseOR(line_no)
    return F.when(outside, F.raise_error(F.lit("more than 65,536 files or a file above 128 TiB")).cast("bigint")).otherwise(number)


def sample_map(headers: list[Header]) -> Column:
    """(file, number of a sample in it) to the sample's number in the output, as a map from "file:number"."""
    return F.create_map(*[F.lit(x) for (f, i), k in sample_index(headers).items() for x in (f"{f}:{i}", k)])


def support_mask(fmt: Column, samples: Column, vcf_id: Column, headers: list[Header]) -> Column:
    """The output samples that carry an alternative allele, as words of a mask."""
    first = [k for k, _ in enumerate(headers)]
    begin = F.array(*[F.lit(sum(len(h.samples) for h in headers[:f])) for f in first])
    carried = F.filter(F.transform(support(fmt, samples), lambda flag, i: F.when(flag, i)), lambda i: i.isNotNull())
    return masks.of_samples(F.transform(carried, lambda i: F.get(begin, vcf_id) + i), masks.words_for(sum(len(h.samples) for h in headers)))


def _genotype(sample: Column, place: Column) -> Column:
    return F.get(F.split(sample, ":"), place)


def support(fmt: Column, samples: Column) -> Column:
    """Array of flags: which samples carry an alternative allele."""
    place = F.array_position(F.split(fmt, ":"), "GT").cast("int") - 1
    return F.transform(samples, lambda s: F.exists(F.split(F.coalesce(_genotype(s, place), F.lit(".")), "[/|]"), lambda a: F.coalesce(a.try_cast("int") > 0, F.lit(False))))


def _fail(test: Column, message: str, otherwise: Column) -> Column:
    return F.when(test, F.raise_error(F.lit(message)).cast("string")).otherwise(otherwise)


def derive_calls(raw: DataFrame, headers: list[Header], cfg: MergeConfig) -> DataFrame:
    """Calls with the columns that clustering, aggregation and writing use.

    Contig, region and class filters come before parsing, so broken rows outside the selection do no harm.  A missing or
    unknown SVTYPE, a missing SVLEN (but for breakends) and confidence intervals that are incomplete, of wrong size or
    reversed are errors that name the field.
    """
    sample_index(headers)
    if cfg.contig:
        unknown = set(cfg.contig) - set(contig_order(headers))
        if unknown:
            raise SourceError(f"contigs are in no header: {sorted(unknown)}")
        raw = raw.filter(F.col("chrom").isin(*cfg.contig))
    rows = raw.withColumn("pos0", F.col("pos") - 1).withColumn("_info", fields.info_map(F.col("info")))
    if cfg.target_positions:
        rows = in_regions(rows, regions(list(cfg.target_positions)), "chrom")
    info = F.col("_info")
    rows = rows.withColumn("_kind", fields.first_value(info, "SVTYPE"))
    rows = rows.withColumn("bucket", fields.bucket_class(F.col("_kind"), F.col("id")))
    rows = rows.filter(F.col("_kind").isNull() | F.col("bucket").isin(*cfg.svtype) | ~F.col("_kind").isin("INS", "DEL", "INV", "DUP", "CNV", "BND"))
    kind = _fail(F.col("_kind").isNull(), "SVTYPE is missing", F.col("_kind"))
    rows = rows.withColumn("svtype", F.when(kind.isin("INS", "DEL", "INV", "DUP", "CNV", "BND"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown SVTYPE "), kind)).cast("string")))
    length = fields.first_number(info, "SVLEN")
    rows = rows.withColumn("svlen", F.when(length.isNotNull(), length).when(F.col("svtype") == "BND", 0.0).otherwise(F.raise_error(F.lit("SVLEN is missing")).cast("double")))

    cipos, ciend = fields.numbers(info, "CIPOS"), fields.numbers(info, "CIEND")
    for name, ci in (("CIPOS", cipos), ("CIEND", ciend)):
        wrong = (F.size(ci) > 0) & ((F.size(ci) != 2) | (F.get(ci, F.lit(0)) > F.get(ci, F.lit(1))))
        rows = rows.withColumn("svtype", _fail(wrong, f"{name} needs two ordered values", F.col("svtype")))
    spanning = F.col("svtype").isin("DEL", "INV", "DUP", "CNV")
    has_pos, has_end = F.size(cipos) == 2, F.size(ciend) == 2
    rows = rows.withColumn("svtype", _fail(spanning & has_pos & ~has_end, "incomplete CI fields: CIPOS without CIEND", F.col("svtype")))
    rows = rows.withColumn("svtype", _fail((F.col("svtype") == "INS") & has_end, "CIEND on an insertion", F.col("svtype")))
    centre = lambda ci: (F.get(ci, F.lit(0)) + F.get(ci, F.lit(1))) / 2
    variance = lambda ci: F.pow((F.get(ci, F.lit(1)) - F.get(ci, F.lit(0))) / 2 / 1.96, 2)
    end = F.coalesce(fields.first_number(info, "END"), F.col("pos") + F.abs("svlen"))
    start_mean = F.when(has_pos, F.col("pos") + centre(cipos)).otherwise(F.col("pos").cast("double"))
    sign = F.when(F.col("svtype") == "DEL", -1.0).otherwise(1.0)
    mask = support_mask(F.col("format"), F.col("samples"), F.col("vcf_id"), headers)
    merged_before = sample_map(headers)
    ident = fields.output_id(F.col("id"), F.col("vcf_id"), merged_before)
    listed = fields.values(info, "IDLIST")
    claims = F.sort_array(F.array_distinct(F.concat(fields.values(info, "SVCLAIM"), fields.values(info, "SVCLAIM_SET"))))
    alt = F.get(F.split("alt", ","), F.lit(0))
    literal = (F.col("svtype") == "INS") & ~alt.isin("", ".", "*") & ~alt.startswith("<") & ~alt.rlike(r"[\[\]]")
    point = notation.plane_point(F.col("chrom"), F.col("pos0"), notation.mate_contig(alt), notation.mate_pos0(alt))
    bnd = F.col("svtype") == "BND"
    calls = rows.select(
        "vcf_id",
        "line_no",
        F.col("chrom").alias("contig"),
        "pos0",
        "bucket",
        "svtype",
        F.concat_ws(":", "chrom", "bucket").alias("block"),
        ident.alias("id"),
        F.col("id").alias("raw_id"),
        F.col("vcf_id").alias("sample_id"),
        F.when(bnd, point["start"]).otherwise(F.col("pos0").cast("double")).alias("start"),
        F.when(bnd, point["end"]).otherwise(F.abs("svlen")).alias("end"),
        "svlen",
        start_mean.alias("start_mean"),
        F.when(has_pos, variance(cipos)).otherwise(0.0).alias("start_variance"),
        F.when(spanning & has_end, sign * F.abs(end + centre(ciend) - start_mean)).otherwise(F.col("svlen")).alias("svlen_mean"),
        F.when(spanning & has_end, F.when(has_pos, variance(cipos)).otherwise(0.0) + variance(ciend)).otherwise(0.0).alias("svlen_variance"),
        mask.alias("support_mask"),
        F.coalesce(fields.first_number(info, "SUPP_CALLS").cast("bigint"), F.lit(1)).alias("support_calls"),
        F.when(bnd, F.lit(float(cfg.max_dist))).otherwise(merge_radius(F.col("svlen"), cfg)).alias("max_dist"),
        text_hash("info").alias("info_hash"),
        F.when(F.size(listed) > 0, F.transform(listed, lambda x: fields.output_id(x, F.col("vcf_id"), merged_before))).otherwise(F.array(ident)).alias("id_list"),
        F.get(claims, F.lit(0)).alias("svclaim"),
        F.when(spanning, F.col("pos0").cast("double")).alias("interval_start"),
        F.when(spanning, F.coalesce(fields.first_number(info, "END"), F.col("pos0") + F.abs("svlen"))).alias("interval_end"),
        F.when(literal, F.upper(alt)).alias("sequence"),
        "ref",
        "alt",
        "filter",
        "format",
        "samples",
        "_info",
    )
    if not cfg.keep_monomorphic:
        calls = calls.filter(~masks.empty(F.col("support_mask")))
    return calls.withColumn("idx", row_index(F.col("vcf_id"), F.col("line_no")))


def derive_breakends(raw: DataFrame, headers: list[Header], cfg: MergeConfig) -> DataFrame:
    """Breakend records in the form that ``operators.mates`` pairs; CHR2 and END must agree with ALT if given.

    Contigs and regions choose breakends by their own place; AVG_START and AVG_END give the plane point where they stand, CIPOS the spread.
    """
    rows = raw.filter(F.col("chrom").isin(*cfg.contig)) if cfg.contig else raw
    rows = rows.withColumn("_info", fields.info_map(F.col("info"))).filter(fields.first_value(F.col("_info"), "SVTYPE") == "BND")
    if cfg.target_positions:
        rows = in_regions(rows.withColumn("pos0", F.col("pos") - 1), regions(list(cfg.target_positions)), "chrom")
    info, alt = F.col("_info"), F.get(F.split("alt", ","), F.lit(0))
    other, place = notation.mate_contig(alt), notation.mate_pos0(alt)
    named, end = fields.first_value(info, "CHR2"), fields.first_number(info, "END")
    checked = F.when(named.isNotNull() & (named != other), F.raise_error(F.lit("CHR2 differs from ALT")).cast("string"))
    checked = checked.when(end.isNotNull() & (end != place + 1), F.raise_error(F.lit("END differs from the position in ALT")).cast("string")).otherwise(other)
    mate = fields.values(info, "MATEID")
    missing = F.when(F.size(mate) == 0, F.raise_error(F.lit("MATEID is missing")).cast("string")).otherwise(F.get(mate, F.lit(0)))
    gt = F.array_position(F.split("format", ":"), "GT").cast("int") - 1
    inverted = fields.first_value(info, "EVENTTYPE") == "INV"
    pos0 = F.col("pos") - 1
    point = notation.plane_point(F.col("chrom"), pos0, other, place, fields.first_number(info, "AVG_START"), fields.first_number(info, "AVG_END"))
    ci = fields.numbers(info, "CIPOS")
    wrong = (F.size(ci) > 0) & ((F.size(ci) != 2) | (F.get(ci, F.lit(0)) > F.get(ci, F.lit(1))))
    low, high = F.get(ci, F.lit(0)), F.get(ci, F.lit(1))
    width = F.when(wrong, F.raise_error(F.lit("CIPOS needs two ordered values")).cast("double")).when(F.size(ci) == 2, F.pow((high - low) / 2 / 1.96, 2)).otherwise(0.0)
    again = sample_map(headers)
    listed = fields.values(info, "IDLIST")
    ident = lambda x: fields.output_id(x, F.col("vcf_id"), again)
    return rows.select(
        row_index(F.col("vcf_id"), F.col("line_no")).alias("rec_id"),
        "vcf_id",
        ident(F.col("id")).alias("id"),
        ident(missing).alias("mate_id"),
        F.col("chrom").alias("contig"),
        pos0.alias("pos0"),
        checked.alias("mate_contig"),
        place.alias("mate_pos0"),
        notation.strands(alt, fields.first_value(info, "STRANDS")).alias("strands"),
        fields.first_number(info, "HOMLEN").cast("bigint").alias("homlen"),
        F.when(inverted, fields.first_value(info, "EVENT")).alias("inv_event_id"),
        fields.has_filter(F.col("filter"), "InvBreakpoint").alias("inv_filter"),
        F.transform("samples", lambda x: F.get(F.split(x, ":"), gt)).alias("gts"),
        F.coalesce(fields.first_number(info, "SUPP_CALLS").cast("bigint"), F.lit(1)).alias("support_calls"),
        support_mask(F.col("format"), F.col("samples"), F.col("vcf_id"), headers).alias("support_mask"),
        point["start"].alias("start"),
        point["end"].alias("end"),
        (F.col("pos") + F.when(F.size(ci) == 2, (low + high) / 2).otherwise(0.0)).alias("start_mean"),
        width.alias("start_variance"),
        F.when(F.size(listed) > 0, F.transform(listed, ident)).otherwise(F.array(ident(F.col("id")))).alias("id_list"),
        text_hash("info").alias("info_hash"),
        F.coalesce(F.substring("ref", 1, 1), F.lit("N")).alias("ref_base"),
        notation.anchor(alt).alias("anchor"),
        "format",
        "samples",
    )
