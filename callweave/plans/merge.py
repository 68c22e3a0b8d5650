"""The merge of many call files into one call set, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.config import ConfigError, MergeConfig
from callweave.functions import masks
from callweave.operators import aggregate as agg
from callweave.operators import mates
from callweave.operators.cluster import cluster_calls
from callweave.operators.intervals import repeat_of_deletions, repeat_of_insertions
from callweave.session import cut
from callweave.sinks import vcf as sink
from callweave.sources import text, vcf

_FIRST_TAGS = ("GT", "GQ", "PL", "AD")


@dataclass(frozen=True)
class Merged:
    """What a merge yields: records with rendered samples, memberships, calls, and the parts of a header."""

    records: DataFrame
    membership: DataFrame
    calls: DataFrame
    contigs: dict[str, int | None]
    samples: tuple[str, ...]
    headers: tuple[vcf.Header, ...] = ()

    def lines(self, ordered: bool = False) -> DataFrame:
        made = sink.record_lines(self.records)
        return sink.sorted_lines(made, self.contigs) if ordered else made

    def header(self, version: bool = True, command: str | None = None) -> str:
        return sink.header_text(self.contigs, self.samples, vcf.declared_fields(self.headers), version, command)


def annotate_repeats(calls: DataFrame, repeats: DataFrame, cfg: MergeConfig) -> DataFrame:
    """Adds the repeat of insertions and deletions; other classes have none."""
    dels = calls.filter(F.col("svtype") == "DEL").select(
        "idx", "contig", F.col("pos0").alias("del_start"), (F.col("pos0") + F.abs("svlen").cast("bigint")).alias("del_end")
    )
    ins = calls.filter(F.col("svtype") == "INS").select("idx", "contig", (F.col("pos0") + 1).alias("pos"))
    best = repeat_of_deletions(dels, repeats, cfg.tr_span_query_slop, cfg.tr_min_span_containment, cfg.tr_min_span_overlap_bp)
    best = best.unionByName(repeat_of_insertions(ins, repeats, cfg.tr_ins_max_dist))
    joined = calls.join(best.withColumnRenamed("tr_id", "trid"), "idx", "left")
    return joined.filter(F.col("trid").isNull()) if cfg.filter_tr_contained else joined


def format_order(tags) -> F.Column:
    """GT, GQ, PL, AD first, the rest by name."""
    rank = F.array(*[F.lit(t) for t in _FIRST_TAGS])
    place = lambda t: F.when(F.array_contains(rank, t), F.array_position(rank, t)).otherwise(99)
    return F.transform(F.array_sort(F.transform(tags, lambda t: F.struct(place(t).alias("p"), t.alias("t")))), lambda s: s["t"])


def _same_types(headers: list[vcf.Header]) -> tuple[Column | None, list[str]]:
    """("file:tag" to type, the tags) for FORMAT tags that the files declare with different types; null if there are none."""
    kinds = [vcf.format_types(h) for h in headers]
    odd = sorted({t for k in kinds for t in k if len({x[t] for x in kinds if t in x}) > 1})
    pairs = [F.lit(x) for f, k in enumerate(kinds) for t in odd if t in k for x in (f"{f}:{t}", k[t])]
    return (F.create_map(*pairs) if pairs else None), odd


def _padded(gt: Column, ploidy: Column) -> Column:
    """A genotype with missing alleles up to the ploidy of its record."""
    have = F.size(F.split(gt, "[/|]"))
    return F.concat(gt, F.repeat(F.lit("/."), F.greatest(ploidy - have, F.lit(0))))


def sample_columns(members: DataFrame, headers: list[vcf.Header]) -> DataFrame:
    """(block, group_id, format, cells): rendered FORMAT values of each cluster.

    A cluster of one call keeps all samples of its file as they are.  In others a sample that supports the cluster shows the
    values of its first supporting member in member order; the rest is missing.  Genotypes are padded to the record's ploidy, at least two.
    A tag that members carry with different declared types is an error.
    """
    n_samples = sum(len(h.samples) for h in headers)
    begin = F.array(*[F.lit(sum(len(h.samples) for h in headers[:f])) for f, _ in enumerate(headers)])
    keys = ["block", "group_id"]
    cells = members.withColumn("first_sample", masks.first(F.col("support_mask"))).select(
        *keys, "first_sample", "id", "idx", "format", "support_mask", "vcf_id", F.posexplode("samples").alias("_i", "_v")
    )
    cells = cells.withColumn("sample", F.get(begin, F.col("vcf_id")) + F.col("_i"))
    kinds, odd = _same_types(headers)
    tags_of = lambda f: F.split(f, ":")
    aggregates = [F.count("*").alias("_n"), F.first("format").alias("_f"), F.collect_set("format").alias("_all")]
    if kinds is not None:
        typed = F.transform(F.filter(tags_of(F.col("format")), lambda t: t.isin(*odd)), lambda t: F.struct(t.alias("t"), F.try_element_at(kinds, F.concat_ws(":", F.col("vcf_id").cast("string"), t)).alias("k")))
        aggregates.append(F.array_distinct(F.flatten(F.collect_set(typed))).alias("_kinds"))
    sizes = members.groupBy(*keys).agg(*aggregates)
    joined = cells.join(sizes.select(*keys, "_n"), keys).filter((F.col("_n") == 1) | masks.holds(F.col("support_mask"), F.col("sample")))
    best = joined.groupBy(*keys, "sample").agg(F.min(F.struct("first_sample", "id", "idx", "format", "_v")).alias("_b"))
    tags = F.array_distinct(F.flatten(F.transform("_all", tags_of)))
    chosen = F.when(F.col("_n") == 1, tags_of(F.col("_f"))).otherwise(format_order(tags))
    if kinds is not None:
        clash = F.size("_kinds") > F.size(F.array_distinct(F.transform("_kinds", lambda s: s["t"])))
        told = F.concat(F.lit("FORMAT tags of different types are merged: "), F.array_join(F.transform("_kinds", lambda s: F.concat_ws(" ", s["t"], s["k"])), ", "))
        chosen = F.when(clash, F.raise_error(told).cast("array<string>")).otherwise(chosen)
    layout = sizes.select(*keys, chosen.alias("_tags"))
    pairs = F.map_from_arrays(tags_of(F.col("_b.format")), F.transform(tags_of(F.col("_b.format")), lambda t, i: F.coalesce(F.get(F.split("_b._v", ":"), i), F.lit("."))))
    filled = best.select(*keys, F.struct("sample", pairs.alias("m")).alias("_s")).groupBy(*keys).agg(F.map_from_entries(F.collect_list("_s")).alias("_cells"))
    whole = layout.join(filled, keys, "left")
    genotypes = F.transform(F.map_values("_cells"), lambda m: F.size(F.split(F.coalesce(F.try_element_at(m, F.lit("GT")), F.lit("./.")), "[/|]")))
    whole = whole.withColumn("_ploidy", F.greatest(F.lit(2), F.coalesce(F.array_max(genotypes), F.lit(2))))
    missing = lambda t: F.when(t == "GT", F.concat(F.lit("."), F.repeat(F.lit("/."), F.col("_ploidy") - 1))).otherwise(F.lit("."))
    value = lambda m, t: F.when((t == "GT") & F.try_element_at(m, t).isin("", "."), missing(t)).when(t == "GT", _padded(F.try_element_at(m, t), F.col("_ploidy"))).otherwise(F.try_element_at(m, t))
    cell = lambda i: F.array_join(F.transform("_tags", lambda t: F.coalesce(value(F.try_element_at("_cells", i), t), missing(t))), ":")
    every = F.transform(F.sequence(F.lit(0), F.lit(n_samples - 1)), cell)
    return whole.select(*keys, F.array_join("_tags", ":").alias("format"), every.alias("cells"))


def merge_files(spark: SparkSession, paths: list[str], cfg: MergeConfig | None = None, repeats: str | None = None) -> Merged:
    """Merge call files (text) of all classes but breakends; ``merge_breakends`` does those."""
    cfg = cfg or MergeConfig()
    if len(paths) < 2 and not cfg.force_single:
        raise ConfigError("fewer than two inputs; set force_single to merge one file")
    for path in paths:
        vcf.validate(path)
    headers = [vcf.read_header(p) for p in paths]
    words = masks.words_for(sum(len(h.samples) for h in headers))
    calls = vcf.derive_calls(vcf.raw_records(spark, paths), headers, cfg).filter(F.col("bucket") != "BND")
    if repeats:
        calls = annotate_repeats(cut(calls), text.repeat_catalog(spark, repeats), cfg)
    else:
        calls = calls.withColumn("trid", F.lit(None).cast("string")).withColumn("motif_len", F.lit(0))
    calls = cut(calls.drop("_info"))
    membership = cut(cluster_calls(calls, cfg))
    members = cut(calls.join(membership, ["block", "idx"]))
    records = agg.merged_records(members, cfg, words)
    alleles = members.select(F.col("idx").alias("rep_idx"), "ref", "alt")
    records = records.join(alleles, "rep_idx").drop("rep_idx")
    records = records.withColumn("alt", F.when(F.col("svtype") == "CNV", "<CNV>").otherwise(F.col("alt")))
    records = records.join(sample_columns(members, headers), ["block", "group_id"])
    return Merged(records, membership, calls, vcf.contig_order(headers), tuple(s for h in headers for s in h.samples), tuple(headers))


def merge_breakends(spark: SparkSession, paths: list[str], cfg: MergeConfig | None = None) -> DataFrame:
    """Merge the breakends of call files: two records per merged event with their samples, ready for ``record_lines``.

    Contigs and regions choose breakends; a breakend whose mate isn't among those chosen is dropped.  Pairs that disagree raise an error that
    names what differs, and so does a breakend that could be paired with several others.
    """
    cfg = cfg or MergeConfig()
    headers = [vcf.read_header(p) for p in paths]
    vcf.sample_index(headers)
    words = masks.words_for(sum(len(h.samples) for h in headers))
    found = mates.paired(cut(vcf.derive_breakends(vcf.raw_records(spark, paths), headers, cfg)))
    events = mates.events(mates.unambiguous(cut(found)), words)
    events = cut(events if cfg.keep_monomorphic else events.filter(~masks.empty(F.col("support_mask"))))
    membership = cut(cluster_calls(mates.as_calls(events, cfg.max_dist), cfg))
    records = mates.merged_events(events, membership, words)
    members = events.join(membership.select("idx", "group_id"), "idx").withColumnRenamed("a_vcf_id", "vcf_id")
    sides = [sample_columns(members.withColumnsRenamed({f"{s}_format": "format", f"{s}_samples": "samples"}), headers).withColumn("side", F.lit(s)) for s in "ab"]
    keep = (F.col("supp") >= cfg.min_supp) | ((F.col("supp") == 0) if cfg.keep_monomorphic else F.lit(False))
    records = records.filter(keep).join(sides[0].unionByName(sides[1]), ["block", "group_id", "side"])
    return records.withColumn("svtype", F.lit("BND")).withColumn("filter", F.when(F.col("eventtype") == "INV", "InvBreakpoint"))


def orphans_in_scope(spark: SparkSession, paths: list[str], cfg: MergeConfig) -> DataFrame:
    """Breakends without a mate although its place was chosen too: what a merge drops and should tell."""
    headers = [vcf.read_header(p) for p in paths]
    rows = vcf.derive_breakends(vcf.raw_records(spark, paths), headers, cfg)
    regions = text.regions(list(cfg.target_positions)) if cfg.target_positions else []
    return mates.in_scope(mates.orphans(cut(rows)), list(cfg.contig), regions)
