"""Breakends: pairing of mates within a file, events, and merged event records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import breakends as notation
from callweave.functions import masks
from callweave.functions.scalars import checked_int, round_half_up, text_hash
from callweave.operators.aggregate import _mean, _spread, interval_offsets


def current_breakends(rows: DataFrame) -> DataFrame:
    """One row per (vcf_id, id): the last loaded delivery, ties to the greater ``rec_id``; deleted rows are out."""
    live = rows.filter(F.col("deleted_at").isNull() & F.col("id").isNotNull())
    columns = [c for c in rows.columns if c not in ("vcf_id", "id")]
    order = F.struct(F.col("loaded_at").alias("_t"), F.col("rec_id").alias("_i"))
    best = live.groupBy("vcf_id", "id").agg(F.max_by(F.struct(*columns), order).alias("_r"))
    return best.select("vcf_id", "id", *[F.col(f"_r.{c}").alias(c) for c in columns])


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def paired(breakends: DataFrame) -> DataFrame:
    """Reciprocal mates of one file, the canonical side (smaller contig, position, id) first.

    Both sides must name each other.  Coordinates must agree with what the mate says, exactly or by the homology
    length of either side; genotypes and support must be equal.  ``reason`` is null for a good pair, else says what disagrees.
    """
    a, b = _side(breakends, "a_"), _side(breakends, "b_")
    place = lambda s: F.struct(f"{s}_contig", f"{s}_pos0", f"{s}_id")
    both = a.join(b, (F.col("a_vcf_id") == F.col("b_vcf_id")) & (F.col("a_mate_id") == F.col("b_id")) & (F.col("b_mate_id") == F.col("a_id")))
    both = both.filter(place("a") < place("b"))
    homology = F.array(F.lit(0), F.coalesce(F.col("a_homlen"), F.lit(0)), F.coalesce(F.col("b_homlen"), F.lit(0)))
    off = lambda x, y: ~F.array_contains(homology, F.abs(F.col(x) - F.col(y)))
    reason = (
        F.when((F.col("a_mate_contig") != F.col("b_contig")) | (F.col("b_mate_contig") != F.col("a_contig")), "contig")
        .when(off("a_mate_pos0", "b_pos0") | off("b_mate_pos0", "a_pos0"), "position")
        .when(~F.col("a_gts").eqNullSafe(F.col("b_gts")), "genotype")
        .when(~F.col("a_support_calls").eqNullSafe(F.col("b_support_calls")), "support")
    )
    return both.withColumn("reason", reason)


def orphans(breakends: DataFrame) -> DataFrame:
    """Breakends without a reciprocal mate in their file."""
    mates = breakends.select("vcf_id", F.col("id").alias("mate_id"), F.col("mate_id").alias("id")).filter(F.col("mate_id").isNotNull() & F.col("id").isNotNull())
    return breakends.join(mates.distinct(), ["vcf_id", "id", "mate_id"], "left_anti")


def ambiguous(breakends: DataFrame) -> DataFrame:
    """Breakends that more than one record claims as mate."""
    return breakends.filter(F.col("mate_id").isNotNull() & (F.col("mate_id") != ".")).groupBy("vcf_id", "mate_id").agg(F.count("*").alias("n_claims")).filter("n_claims > 1")


def unambiguous(pairs: DataFrame) -> DataFrame:
    """The good pairs; a breakend that could be paired with several others is an error, so each is used once.

    Pairs that disagree are an error too, unless one of their breakends has a good pair.
    """
    ends = F.explode(F.array("a_rec_id", "b_rec_id"))
    uses = pairs.select(ends.alias("rec_id"), F.col("reason").isNull().cast("int").alias("_good")).groupBy("rec_id").agg(F.sum("_good").alias("_uses"))
    for s in ("a", "b"):
        pairs = pairs.join(uses.select(F.col("rec_id").alias(f"{s}_rec_id"), F.col("_uses").alias(f"_{s}_uses")), f"{s}_rec_id")
    used = F.greatest("_a_uses", "_b_uses")
    fault = (
        F.when(used > 1, F.concat(F.lit("several mates can be paired with "), F.col("a_id"), F.lit(" or "), F.col("b_id")))
        .when(used == 0, F.concat(F.lit("mates disagree: "), F.col("reason"), F.lit(" of "), F.col("a_id"), F.lit(" and "), F.col("b_id")))
    )
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col("reason"))
    return pairs.withColumn("reason", checked).filter(F.col("reason").isNull()).drop("_a_uses", "_b_uses")


def in_scope(breakends: DataFrame, contigs: list[str], regions: list[tuple[str, int, int | None]], contig: str = "mate_contig", pos0: str = "mate_pos0") -> DataFrame:
    """Breakends whose mate lies on a chosen contig and, if regions are given, in one of them."""
    from callweave.operators.calls import in_regions

    return in_regions(breakends.filter(F.col(contig).isin(*contigs)) if contigs else breakends, regions, contig, pos0)


def events(pairs: DataFrame, words: int = 1) -> DataFrame:
    """One call per good pair, in the form of clusterable calls: the plane point is the two positions.

    Pairs from files carry plane points, moments, masks, alleles and samples; from tables, which have none, positions are exact and a
    file stands for one sample.
    """
    good = pairs.filter(F.col("reason").isNull())
    have = set(pairs.columns)
    pick = lambda c, otherwise: F.col(c) if c in have else otherwise
    inverted = (F.col("a_inv_event_id") == F.col("b_inv_event_id")) & F.col("a_inv_filter") & F.col("b_inv_filter")
    mask = masks.either(F.col("a_support_mask"), F.col("b_support_mask")) if "a_support_mask" in have else masks.of_samples(F.array("a_vcf_id"), words)
    zero = F.lit(0.0)
    return good.select(
        F.least("a_rec_id", "b_rec_id").alias("idx"),
        notation.block_key(F.col("a_contig"), F.col("b_contig"), F.col("a_strands"), F.col("b_strands")).alias("block"),
        "a_contig",
        "b_contig",
        "a_strands",
        "b_strands",
        F.concat_ws("/", "a_id", "b_id").alias("id"),
        F.col("a_vcf_id").alias("sample_id"),
        pick("a_start", F.col("a_pos0").cast("double")).alias("start"),
        pick("a_end", F.col("a_mate_pos0").cast("double")).alias("end"),
        pick("a_start_mean", F.col("a_pos0") + 1.0).alias("start_mean"),
        pick("a_start_variance", zero).alias("start_variance"),
        pick("b_start_variance", zero).alias("svlen_variance"),
        mask.alias("support_mask"),
        F.coalesce("a_support_calls", F.lit(1)).alias("support_calls"),
        (F.array_union("a_id_list", "b_id_list") if "a_id_list" in have else F.array(F.col("a_id"), F.col("b_id"))).alias("id_list"),
        pick("a_info_hash", text_hash("a_id")).bitwiseXOR(pick("b_info_hash", text_hash("b_id"))).alias("info_hash"),
        F.when(F.coalesce(inverted, F.lit(False)), F.col("a_inv_event_id")).alias("inv_event_id"),
        *[F.struct(pick(f"{s}_ref_base", F.lit("N")).alias("ref"), pick(f"{s}_anchor", F.lit("N")).alias("anchor")).alias(f"{s}_allele") for s in "ab"],
        *[F.col(c) for c in ("a_vcf_id", "a_format", "a_samples", "b_format", "b_samples") if c in have],
    )


def as_calls(event_rows: DataFrame, max_dist: float) -> DataFrame:
    """Events with the columns of clusterable calls; the radius is always the fixed one."""
    return event_rows.select(
        "idx", "block", "id", "sample_id", "start", "end", "support_mask", "support_calls", "info_hash", "id_list", "start_mean", "start_variance", "svlen_variance",
        F.lit(float(max_dist)).alias("max_dist"), F.lit(0.0).alias("svlen"), F.lit("BND").alias("svtype"), F.lit("BND").alias("bucket"), (F.col("end") + 1).alias("svlen_mean"),
        F.lit(None).cast("string").alias("trid"), F.lit(0).alias("motif_len"), F.lit(None).cast("string").alias("svclaim"),
        F.lit(None).cast("double").alias("interval_start"), F.lit(None).cast("double").alias("interval_end"), F.col("block").alias("contig"),
    )


def event_name(a_contig: Column, a_pos: Column, b_contig: Column, b_pos: Column, ids: Column) -> Column:
    """A stable id of a merged event, from its places and a hash of its sorted ids."""
    return F.concat_ws("_", F.lit("ev"), a_contig, a_pos.cast("string"), b_contig, b_pos.cast("string"), text_hash(F.array_join(F.sort_array(ids), "|")).cast("string"))


def merged_events(event_rows: DataFrame, membership: DataFrame, words: int = 1) -> DataFrame:
    """Two records per cluster of events, each naming the other as mate.

    Positions are rounded support-weighted means, CIPOS their spread on each side; reference base and anchor are the smallest
    of the members' on each side; an inversion event is named after its consensus id if all members carry the same.
    """
    keys = ["block", "group_id"]
    rows = event_rows.join(membership.select("idx", "group_id"), "idx").withColumn("end_mean", F.col("end") + 1)
    first = rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("a_contig", "b_contig", "a_strands", "b_strands")],
        *[F.min(f"{s}_allele").alias(f"{s}_allele") for s in "ab"],
        _mean("start_mean").alias("start_mean_of"),
        _mean("end_mean").alias("end_mean_of"),
        masks.union_size("support_mask", words).alias("supp"),
        F.sum("support_calls").alias("supp_calls"),
        F.sort_array(F.flatten(F.collect_list("id_list"))).alias("idlist"),
        F.when((F.min("inv_event_id") == F.max("inv_event_id")) & (F.count("inv_event_id") == F.count("*")), F.min("inv_event_id")).alias("inversion"),
    )
    light = rows.select(*keys, "support_calls", "start_mean", "start_variance", "end_mean", "svlen_variance").join(first.select(*keys, "start_mean_of", "end_mean_of"), keys)
    spread = light.groupBy(*keys).agg(_spread("start_mean", "start_variance").alias("a_var"), _spread("end_mean", "svlen_variance").alias("b_var"))
    merged = first.join(spread, keys).withColumns({"a_pos": round_half_up("start_mean_of"), "b_pos": round_half_up("end_mean_of")})
    name = event_name(F.col("a_contig"), F.col("a_pos"), F.col("b_contig"), F.col("b_pos"), F.col("idlist"))
    merged = merged.withColumn("event", F.coalesce("inversion", name))

    def record(own: str, other: str, mean: str) -> Column:
        lo, hi = interval_offsets(F.col(mean), F.col(f"{own}_var"), F.col(f"{own}_pos"))
        return F.struct(
            F.col(f"{own}_contig").alias("contig"),
            F.col(f"{own}_pos").alias("pos"),
            F.concat_ws("_", "event", F.lit(own.upper())).alias("id"),
            F.concat_ws("_", "event", F.lit(other.upper())).alias("mate_id"),
            F.col(f"{other}_contig").alias("mate_contig"),
            F.col(f"{own}_allele.ref").alias("ref"),
            notation.alt_allele(F.col(f"{other}_contig"), F.col(f"{other}_pos"), F.col(f"{own}_strands"), F.col(f"{own}_allele.anchor")).alias("alt"),
            F.col(f"{own}_strands").alias("strands"),
            F.array(checked_int(lo, "CIPOS"), checked_int(hi, "CIPOS")).alias("cipos"),
            F.lit(own).alias("side"),
        )

    both = merged.withColumn("_r", F.explode(F.array(record("a", "b", "start_mean_of"), record("b", "a", "end_mean_of"))))
    kind = F.when(F.col("inversion").isNotNull(), "INV").alias("eventtype")
    return both.select(*keys, "_r.*", "supp", "supp_calls", "idlist", "event", kind)
