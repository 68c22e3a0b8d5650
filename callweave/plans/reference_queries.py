"""Queries over the call tables, one per operator of the merge, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.config import MergeConfig
from callweave.functions import breakends as notation
from callweave.functions import info as fields
from callweave.functions.scalars import rotated, round_half_up, text_hash
from callweave.operators import aggregate as agg
from callweave.operators import mates
from callweave.operators.calls import clusterable, in_regions, merge_radius
from callweave.operators.cluster import cluster_calls, components
from callweave.operators.ingest import load_catalog, valid_rows
from callweave.operators.intervals import interval_join, repeat_of_deletions, repeat_of_insertions, semi_interval
from callweave.operators.pairs import candidate_pairs, nearest_partners
from callweave.operators.shards import independent_shards
from callweave.plans.data_checks import _P2
from callweave.plans.registry import query
from callweave.sinks.diagnostics import diagnostics
from callweave.sinks.vcf import record_lines
from callweave.session import cut, table

CFG = MergeConfig()
_OPEN = replace(CFG, allow_intrasample=True)

# The clusterable calls, said in SQL.
_CALLS = """calls AS (SELECT call_id AS idx, contig || ':' || variant_type AS block, contig, variant_type AS bucket, coalesce(svtype, variant_type) AS svtype,
  id, sample_id, start_pos AS s, end_pos AS e, coalesce(svlen, end_pos) AS svlen, coalesce(start_mean, start_pos + 1) AS start_mean,
  coalesce(start_variance, 0) AS start_variance, coalesce(svlen_mean, svlen, end_pos) AS svlen_mean, coalesce(svlen_variance, 0) AS svlen_variance,
  support_mask, coalesce(support_calls, 1) AS support_calls, max_dist, id_list, trid, svclaim,
  CASE WHEN trid IS NOT NULL THEN greatest(max_dist, 4000.0) ELSE max_dist END AS reach
  FROM (SELECT DISTINCT ON (call_id) * FROM sv_calls) WHERE contig IS NOT NULL AND start_pos IS NOT NULL AND support_mask <> 0)"""
_PAIR = """pair AS (SELECT a.block, a.idx AS a, b.idx AS b, sqrt((a.s - b.s) * (a.s - b.s) + (a.e - b.e) * (a.e - b.e)) AS dist,
  coalesce(a.trid = b.trid, false) AS same_repeat, a.max_dist AS da, b.max_dist AS db, a.svlen AS la, b.svlen AS lb, a.s AS sa, b.s AS sb, a.bucket,
  (a.support_mask & b.support_mask) <> 0 AS same_sample
  FROM calls a JOIN calls b ON a.block = b.block AND a.idx < b.idx AND abs(a.s - b.s) <= greatest(a.reach, b.reach) + 1e-9
  WHERE NOT coalesce(a.trid <> b.trid, false))"""
_MUTUAL = "near AS (SELECT * FROM pair WHERE dist <= CASE WHEN same_repeat THEN 4000.0 ELSE least(da, db) END + 1e-9)"
_SHARDS = """o AS (SELECT block, idx, s - reach - 1e-9 AS l, s + reach + 1e-9 AS r FROM calls),
w AS (SELECT *, max(r) OVER (PARTITION BY block ORDER BY l, r, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
sh AS (SELECT block, idx, CAST(sum(CASE WHEN before IS NOT NULL AND l > before THEN 1 ELSE 0 END)
  OVER (PARTITION BY block ORDER BY l, r, idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shard FROM w)"""


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sv_calls")


def _calls(spark: SparkSession, folder: str, cfg: MergeConfig = CFG) -> DataFrame:
    """The clusterable calls, deduplicated once and kept: every later step reads them several times."""
    return cut(clusterable(_rows(spark, folder), cfg))


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    loaded = valid_rows(load_catalog(table(spark, folder, "tr_catalog_raw"), "raw_line", ()))
    return loaded.select(F.col("chrom").alias("contig"), F.col("start_pos").alias("start"), F.col("end_pos").alias("stop"), "tr_id", "motif_len")


# --- scans, filters, projections ---------------------------------------------------------------------------------


@query(
    "scan_filter_calls",
    """SELECT call_id, contig, svtype, start_pos FROM sv_calls WHERE contig IN ('chr1', 'chr2', 'chrX') AND svtype IN ('INS', 'DEL')
  AND support_mask <> 0 AND ((contig = 'chr1' AND start_pos >= 1000000 AND start_pos <= 90000000) OR (contig = 'chr2' AND start_pos >= 5000000))""",
)
def scan_filter_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Contig, class, region and support filters, all pushed into the scan."""
    rows = _rows(spark, folder).filter(F.col("contig").isin("chr1", "chr2", "chrX") & F.col("svtype").isin("INS", "DEL") & (F.col("support_mask") != 0))
    regions = [("chr1", 1_000_000, 90_000_000), ("chr2", 5_000_000, None)]
    return in_regions(rows, regions, "contig", "start_pos").select("call_id", "contig", "svtype", "start_pos")


@query(
    "classify_bucket",
    """SELECT contig, CASE WHEN svtype = 'CNV' OR split_part(id, ':', 2) = 'CNV' THEN 'CNV' ELSE svtype END AS bucket, count(*) AS n
  FROM sv_calls GROUP BY 1, 2""",
)
def classify_bucket(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).select("contig", fields.bucket_class(F.col("svtype"), F.col("id")).alias("bucket"))
    return rows.groupBy("contig", "bucket").agg(F.count("*").alias("n"))




@query(
    "parse_info_fields",
    """SELECT call_id, nullif(coalesce(svtype, '.'), '.') AS kind, CAST(floor(svlen) AS DOUBLE) AS len, nullif(svclaim, '.') AS claim,
  CAST(len(list_filter(id_list, lambda x: x <> '' AND x <> '.')) AS INTEGER) AS n_ids FROM sv_calls""",
)
def parse_info_fields(spark: SparkSession, folder: str) -> DataFrame:
    """INFO text made from the columns and read back."""
    text = F.concat_ws(
        ";", F.concat(F.lit("SVTYPE="), F.coalesce("svtype", F.lit("."))), F.concat(F.lit("SVLEN="), F.floor("svlen").cast("string")),
        F.concat(F.lit("SVCLAIM="), F.col("svclaim")), F.lit("PRECISE"), F.concat(F.lit("IDS="), F.array_join("id_list", ",")),
    )
    rows = _rows(spark, folder).select("call_id", fields.info_map(text).alias("info"))
    info = F.col("info")
    return rows.select(
        "call_id",
        fields.first_value(info, "SVTYPE").alias("kind"),
        fields.first_number(info, "SVLEN").alias("len"),
        fields.first_value(info, "SVCLAIM").alias("claim"),
        F.size(fields.values(info, "IDS")).alias("n_ids"),
    )


@query("merge_radius", "SELECT call_id, greatest(0.5 * abs(svlen), 100.0)::DOUBLE AS radius FROM sv_calls WHERE svlen IS NOT NULL")
def radius(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).filter(F.col("svlen").isNotNull()).select("call_id", merge_radius(F.col("svlen"), CFG).alias("radius"))


@query(
    "stable_hash",
    """SELECT call_id, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(id) + 1), lambda i: ascii(substr(id, i, 1))::BIGINT)),
  lambda h, c: (h * 17 + c) % 1000000007) AS INTEGER) AS h FROM sv_calls WHERE id IS NOT NULL""",
)
def stable_hash(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).filter(F.col("id").isNotNull()).select("call_id", text_hash("id").alias("h"))


# --- interval joins ----------------------------------------------------------------------------------------------



_REPEATS = (
    _P2
    + """, cat AS (SELECT chrom AS contig, least(CAST(s AS BIGINT), CAST(e AS BIGINT)) AS start, greatest(CAST(s AS BIGINT), CAST(e AS BIGINT)) AS stop,
  substr(list_filter(items, lambda x: starts_with(x, 'ID='))[1], 4) AS tr_id,
  CAST(list_min(list_transform(string_split(substr(m, 8), ','), lambda x: length(x))) AS INTEGER) AS motif_len FROM r WHERE reason IS NULL),
one AS (SELECT DISTINCT ON (call_id) * FROM sv_calls WHERE contig IS NOT NULL AND start_pos IS NOT NULL)"""
)


@query(
    "tr_containment_del",
    _REPEATS
    + """, d AS (SELECT call_id AS idx, contig, CAST(floor(start_pos) AS BIGINT) AS ds, CAST(floor(start_pos + end_pos) AS BIGINT) AS de FROM one WHERE svtype = 'DEL'),
p AS (SELECT idx, tr_id, motif_len, de - ds AS len, stop - start AS tl, start, greatest(0, least(de, stop) - greatest(ds, start)) AS o
  FROM d JOIN cat USING (contig) WHERE stop >= ds AND start <= de),
b AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY floor(2.0::DOUBLE * o * 1000000 / (len + tl)) DESC, o DESC, tl, start, tr_id) AS rn FROM p WHERE o >= 1 AND o * 1000000 >= 800000 * len)
SELECT idx, tr_id, motif_len FROM b WHERE rn = 1""",
)
def tr_containment_del(spark: SparkSession, folder: str) -> DataFrame:
    """The best repeat of each deletion."""
    rows = _rows(spark, folder).dropDuplicates(["call_id"]).filter((F.col("svtype") == "DEL") & F.col("contig").isNotNull() & F.col("start_pos").isNotNull())
    dels = rows.select(F.col("call_id").alias("idx"), "contig", F.col("start_pos").cast("bigint").alias("del_start"), (F.col("start_pos") + F.col("end_pos")).cast("bigint").alias("del_end"))
    return repeat_of_deletions(dels, _catalog(spark, folder), CFG.tr_span_query_slop, CFG.tr_min_span_containment, CFG.tr_min_span_overlap_bp)


_NEAR_REPEATS = """, ins AS (SELECT call_id AS idx, contig, CAST(floor(start_pos) AS BIGINT) + 1 AS pos FROM one WHERE svtype = 'INS'),
p AS (SELECT idx, tr_id, motif_len, stop - start AS tl, start, greatest(start - pos, pos - stop, 0) AS d0, greatest(start - pos + 1, pos - 1 - stop, 0) AS d1 FROM ins JOIN cat USING (contig)),
b AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY (least(d0, d1) = 0) DESC, least(d0, d1), tl, start, tr_id) AS rn FROM p WHERE least(d0, d1) <= {most}) SELECT idx, tr_id, motif_len FROM b WHERE rn = 1"""


def _insertions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).dropDuplicates(["call_id"]).filter((F.col("svtype") == "INS") & F.col("contig").isNotNull() & F.col("start_pos").isNotNull())
    return rows.select(F.col("call_id").alias("idx"), "contig", (F.col("start_pos") + 1).cast("bigint").alias("pos"))


@query("tr_containment_ins", _REPEATS + _NEAR_REPEATS.format(most=0))
def tr_containment_ins(spark: SparkSession, folder: str) -> DataFrame:
    """The best repeat of each insertion."""
    return repeat_of_insertions(_insertions(spark, folder), _catalog(spark, folder), CFG.tr_ins_max_dist)


@query("tr_near_ins", _REPEATS + _NEAR_REPEATS.format(most=20000))
def tr_near_ins(spark: SparkSession, folder: str) -> DataFrame:
    """The best repeat within 20,000 bases of each insertion: distances decide."""
    return repeat_of_insertions(_insertions(spark, folder), _catalog(spark, folder), 20000)


# Parts stand in as repeats for the interval joins that SQL checks.
_TR = "tr AS (SELECT 'chr' || (1 + p_partkey % 3) AS contig, (p_partkey * 127) % 259200 AS start, (p_partkey * 127) % 259200 + 20 + 10 * p_size AS stop, 'TR' || p_partkey AS tr_id FROM part)"
_EV = "ev AS (SELECT event_id, 'chr' || (1 + user_id % 3) AS contig, CAST(floor(epoch(ts) - 1704067200) AS BIGINT) % 259200 AS q_start, CAST(floor(epoch(ts) - 1704067200) AS BIGINT) % 259200 + CAST(floor(value) AS BIGINT) AS q_end FROM events)"


def _repeats(spark: SparkSession, folder: str) -> DataFrame:
    start = (F.col("p_partkey") * 127) % 259200
    return table(spark, folder, "part").select(
        F.concat(F.lit("chr"), (1 + F.col("p_partkey") % 3).cast("string")).alias("contig"),
        start.cast("bigint").alias("start"),
        (start + 20 + 10 * F.col("p_size")).cast("bigint").alias("stop"),
        F.concat(F.lit("TR"), F.col("p_partkey").cast("string")).alias("tr_id"),
    )


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - 1704067200) % 259200
    return table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("chr"), (1 + F.col("user_id") % 3).cast("string")).alias("contig"), seconds.cast("bigint").alias("q_start"), (seconds + F.floor("value")).cast("bigint").alias("q_end")
    )


for _name, _sql in {
    "overlapping": "t.stop >= e.q_start AND t.start <= e.q_end",
    "contained": "t.start >= e.q_start AND t.stop <= e.q_end",
    "containing": "t.start <= e.q_start AND t.stop >= e.q_end",
}.items():

    @query(f"interval_{_name}", f"WITH {_TR}, {_EV} SELECT event_id, tr_id FROM ev e JOIN tr t ON e.contig = t.contig AND {_sql}")
    def _interval(spark: SparkSession, folder: str, relation: str = _name) -> DataFrame:
        return interval_join(_spans(spark, folder), _repeats(spark, folder), relation).select("event_id", "tr_id")


@query("interval_near", f"WITH {_TR}, {_EV} SELECT event_id, tr_id FROM ev e JOIN tr t ON e.contig = t.contig AND t.stop >= e.q_start - 50 AND t.start <= e.q_end + 50")
def interval_near(spark: SparkSession, folder: str) -> DataFrame:
    return interval_join(_spans(spark, folder), _repeats(spark, folder), pad=50).select("event_id", "tr_id")


@query("region_semi_join", f"WITH {_TR}, {_EV} SELECT event_id FROM ev e WHERE EXISTS (SELECT 1 FROM tr t WHERE e.contig = t.contig AND t.start <= e.q_start AND t.stop >= e.q_end)")
def region_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    return semi_interval(_spans(spark, folder), _repeats(spark, folder), "event_id").select("event_id")


@query("tr_anti_filter", f"WITH {_TR}, {_EV} SELECT event_id FROM ev e WHERE NOT EXISTS (SELECT 1 FROM tr t WHERE e.contig = t.contig AND t.start <= e.q_start AND t.stop >= e.q_end)")
def tr_anti_filter(spark: SparkSession, folder: str) -> DataFrame:
    return semi_interval(_spans(spark, folder), _repeats(spark, folder), "event_id", anti=True).select("event_id")


@query(
    "tr_best_match",
    f"""WITH {_TR}, {_EV}, p AS (SELECT event_id, tr_id, q_end - q_start AS len, stop - start AS tl, start, greatest(0, least(q_end, stop) - greatest(q_start, start)) AS o
  FROM ev e JOIN tr t ON e.contig = t.contig AND t.stop >= e.q_start AND t.start <= e.q_end),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY floor(2.0::DOUBLE * o * 1000000 / (len + tl)) DESC, o DESC, tl, start, tr_id) AS rn FROM p WHERE o >= 1 AND o * 1000000 >= 800000 * len)
SELECT event_id AS idx, tr_id FROM r WHERE rn = 1""",
)
def tr_best_match(spark: SparkSession, folder: str) -> DataFrame:
    """Containment best match on the stand-in repeats."""
    calls = _spans(spark, folder).select(F.col("event_id").alias("idx"), "contig", F.col("q_start").alias("del_start"), F.col("q_end").alias("del_end"))
    return repeat_of_deletions(calls, _repeats(spark, folder).withColumn("motif_len", F.lit(2)), 0, 800_000, 1).select("idx", "tr_id")


# --- similarity join and predicates ------------------------------------------------------------------------------


@query("candidate_pairs", f"WITH {_CALLS}, {_PAIR}, {_MUTUAL} SELECT block, a, b, dist, same_sample FROM near")
def candidate_pairs_query(spark: SparkSession, folder: str) -> DataFrame:
    return candidate_pairs(_calls(spark, folder), CFG).select("block", "a", "b", "dist", "same_sample")


@query("pairs_no_mutual", f"WITH {_CALLS}, {_PAIR} SELECT block, a, b, dist FROM pair WHERE dist <= CASE WHEN same_repeat THEN 4000.0 ELSE greatest(da, db) END + 1e-9")
def pairs_no_mutual(spark: SparkSession, folder: str) -> DataFrame:
    return candidate_pairs(_calls(spark, folder), replace(CFG, no_mutual_distance=True)).select("block", "a", "b", "dist")


@query(
    "pairs_size_sim",
    f"""WITH {_CALLS}, {_PAIR}, {_MUTUAL} SELECT block, a, b FROM near WHERE (abs(la) <= 1e-9 AND abs(lb) <= 1e-9)
  OR least(CASE WHEN abs(la) <= 1e-9 THEN 1 ELSE abs(la) END, CASE WHEN abs(lb) <= 1e-9 THEN 1 ELSE abs(lb) END)
   / greatest(CASE WHEN abs(la) <= 1e-9 THEN 1 ELSE abs(la) END, CASE WHEN abs(lb) <= 1e-9 THEN 1 ELSE abs(lb) END) >= 0.7 - 1e-9""",
)
def pairs_size_sim(spark: SparkSession, folder: str) -> DataFrame:
    return candidate_pairs(_calls(spark, folder), replace(CFG, allow_intrasample=True, min_size_similarity=0.7)).select("block", "a", "b")


@query(
    "pairs_recip_overlap",
    f"""WITH {_CALLS}, {_PAIR}, {_MUTUAL} SELECT block, a, b FROM near WHERE bucket IN ('INS', 'BND')
  OR (least(sa + abs(la), sb + abs(lb)) - greatest(sa, sb) > 0 AND (least(sa + abs(la), sb + abs(lb)) - greatest(sa, sb)) + 1e-9
    >= greatest(abs(la), abs(lb)) * CASE WHEN same_repeat THEN 0.0 ELSE CAST(0.5 AS FLOAT)::DOUBLE END)""",
)
def pairs_recip_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return candidate_pairs(_calls(spark, folder), replace(CFG, allow_intrasample=True, min_reciprocal_overlap=0.5)).select("block", "a", "b")


_SEQ = """seq AS (SELECT rec_id, contig, pos0, upper(list_filter(alleles, lambda x: regexp_full_match(x, '[ACGTNacgtn]+'))[1]) AS t FROM write_records),
sp AS (SELECT a.rec_id AS a, b.rec_id AS b, a.t AS s, b.t AS t FROM seq a JOIN seq b ON a.contig = b.contig AND a.rec_id < b.rec_id AND abs(a.pos0 - b.pos0) <= 20000 WHERE a.t IS NOT NULL AND b.t IS NOT NULL)"""


def _sequence_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """First literal alleles of records near each other, by a join on bins."""
    plain = F.filter("alleles", lambda x: x.rlike("^[ACGTNacgtn]+$"))
    seq = table(spark, folder, "write_records").select("rec_id", "contig", "pos0", F.upper(F.get(plain, F.lit(0))).alias("t")).filter(F.col("t").isNotNull())
    binned = seq.withColumn("bin", F.floor(F.col("pos0") / 20000))
    left = binned.select(F.col("rec_id").alias("a"), "contig", F.col("pos0").alias("p"), F.col("t").alias("s"), F.explode(F.array(F.col("bin") - 1, "bin", F.col("bin") + 1)).alias("bin"))
    return left.join(binned, ["contig", "bin"]).filter((F.col("a") < F.col("rec_id")) & (F.abs(F.col("p") - F.col("pos0")) <= 20000)).select("a", F.col("rec_id").alias("b"), "s", "t")


@query(
    "seq_similarity_pairs",
    f"WITH {_SEQ} SELECT a, b, CAST(levenshtein(s, t) AS INTEGER) AS edits FROM sp WHERE least(length(s), length(t))::FLOAT / greatest(length(s), length(t))::FLOAT >= CAST(0.8 AS FLOAT) AND (1::FLOAT - levenshtein(s, t)::FLOAT / greatest(length(s), length(t))::FLOAT) >= CAST(0.8 AS FLOAT)",
)
def seq_similarity_pairs(spark: SparkSession, folder: str) -> DataFrame:
    from callweave.functions.predicates import text_similar

    pairs = _sequence_pairs(spark, folder)
    return pairs.filter(text_similar(F.col("s"), F.col("t"), F.lit(0.8).cast("float"))).select("a", "b", F.levenshtein("s", "t").alias("edits"))


_SIMILAR = """least(length({s}), length({t}))::FLOAT / greatest(length({s}), length({t}))::FLOAT >= {least} AND (1::FLOAT - levenshtein({s}, {t})::FLOAT / greatest(length({s}), length({t}))::FLOAT) >= {least}"""
_ROTATED = "(right({t}, ((({x}) % length({t}) + length({t})) % length({t}))::INTEGER) || left({t}, (length({t}) - (({x}) % length({t}) + length({t})) % length({t}))::INTEGER))"
_LITERAL = """lit AS (SELECT rec_id, contig, pos0, upper(list_filter(alleles, lambda x: regexp_full_match(x, '[ACGTNacgtn]+'))[1]) AS t FROM write_records WHERE contig IS NOT NULL AND pos0 IS NOT NULL),
near AS (SELECT a.rec_id AS a, b.rec_id AS b, a.t AS s, b.t AS t, a.pos0 - b.pos0 AS delta FROM lit a JOIN lit b ON a.contig = b.contig AND a.rec_id < b.rec_id
  WHERE a.t IS NOT NULL AND b.t IS NOT NULL AND sqrt((a.pos0 - b.pos0)::DOUBLE ** 2 + (length(a.t) - length(b.t))::DOUBLE ** 2) <= {limit} + 1e-9)"""


def _literal_calls(spark: SparkSession, folder: str, repeat: bool) -> DataFrame:
    """Records with a literal allele as insertions at their place; ``repeat``: those of a contig in one repeat with a motif of three bases."""
    plain = F.filter("alleles", lambda x: x.rlike("^[ACGTNacgtn]+$"))
    rows = table(spark, folder, "write_records").select("rec_id", "vcf_id", "contig", "pos0", F.upper(F.get(plain, F.lit(0))).alias("sequence")).filter("sequence IS NOT NULL AND contig IS NOT NULL AND pos0 IS NOT NULL")
    none = F.lit(None)
    return rows.select(
        F.col("rec_id").alias("idx"), F.col("contig").alias("block"), F.col("pos0").cast("double").alias("start"), F.length("sequence").cast("double").alias("end"),
        F.length("sequence").cast("double").alias("svlen"), F.lit("INS").alias("svtype"), F.lit(20000.0).alias("max_dist"), F.array(F.lit(1).cast("bigint")).alias("support_mask"),
        (F.concat(F.lit("R"), "contig") if repeat else none.cast("string")).alias("trid"), F.lit(3).alias("motif_len"), "sequence",
        none.cast("double").alias("interval_start"), none.cast("double").alias("interval_end"),
    )


@query("pairs_sequence", f"WITH {_LITERAL.format(limit=20000.0)} SELECT a, b FROM near WHERE " + _SIMILAR.format(s="s", t="t", least="CAST(0.8 AS FLOAT)"))
def pairs_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """The similarity join with sequences: near places, like sequences."""
    return candidate_pairs(cut(_literal_calls(spark, folder, False)), _OPEN).select("a", "b")


_TURNS = " OR ".join(
    f"(({x}) <> 0 AND (({_SIMILAR.format(s=s, t=t, least='CAST(0.6 AS FLOAT)')})))"
    for x in ("delta", "-delta", "((delta % 3) + 3) % 3", "-(((delta % 3) + 3) % 3)")
    for s, t in (("s", _ROTATED.format(t="t", x=x)), (_ROTATED.format(t="s", x=x), "t"))
)


@query("pairs_rotation", f"WITH {_LITERAL.format(limit=4000.0)} SELECT a, b FROM near WHERE ({_SIMILAR.format(s='s', t='t', least='CAST(0.6 AS FLOAT)')}) OR {_TURNS}")
def pairs_rotation(spark: SparkSession, folder: str) -> DataFrame:
    """The similarity join within repeats: the repeat's own thresholds, sequences turned by their offset."""
    return candidate_pairs(cut(_literal_calls(spark, folder, True)), _OPEN).select("a", "b")


@query("seq_rotation", "SELECT rec_id, CASE WHEN length(alleles[1]) = 0 THEN alleles[1] ELSE right(alleles[1], (pos0 % length(alleles[1]))::INTEGER) || left(alleles[1], (length(alleles[1]) - pos0 % length(alleles[1]))::INTEGER) END AS turned FROM write_records WHERE alleles[1] IS NOT NULL")
def seq_rotation(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "write_records").withColumn("t", F.get("alleles", F.lit(0))).filter(F.col("t").isNotNull())
    return rows.select("rec_id", rotated(F.col("t"), F.col("pos0")).alias("turned"))


@query(
    "knn_points",
    f"""WITH {_CALLS}, {_PAIR}, {_MUTUAL}, h AS (SELECT a AS u, b AS v, dist FROM near UNION ALL SELECT b, a, dist FROM near),
r AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY dist, v) AS rank FROM h) SELECT u, v, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4""",
)
def knn_points(spark: SparkSession, folder: str) -> DataFrame:
    """The up to four nearest eligible partners of each call, by distance, then index."""
    return nearest_partners(candidate_pairs(_calls(spark, folder), _OPEN), 4)


# --- shards and clusters -----------------------------------------------------------------------------------------


@query("independent_shards", f"WITH {_CALLS}, {_SHARDS} SELECT block, idx, shard FROM sh")
def independent_shards_query(spark: SparkSession, folder: str) -> DataFrame:
    return independent_shards(_calls(spark, folder), CFG)


_COMPONENTS = f"""{_CALLS}, {_PAIR}, {_MUTUAL},
half AS (SELECT a AS u, b AS v FROM near UNION ALL SELECT b, a FROM near),
walk AS (SELECT idx AS node, idx AS root FROM calls UNION SELECT h.v, w.root FROM walk w JOIN half h ON h.u = w.node WHERE w.root < h.v),
comp AS (SELECT node, min(root) AS component FROM walk GROUP BY node),
mem AS (SELECT c.*, component AS group_id, CAST(CASE WHEN support_mask < 0 AND (support_mask & 9223372036854775807) = 0 THEN 63 ELSE bit_count(~support_mask & (support_mask - 1)) END AS INTEGER) AS first_sample FROM calls c JOIN comp ON idx = node)"""


def _components(spark: SparkSession, folder: str) -> DataFrame:
    calls = _calls(spark, folder)
    return components(calls.select(F.col("idx").alias("node")), candidate_pairs(calls, _OPEN).select("a", "b"))


def _members(spark: SparkSession, folder: str) -> DataFrame:
    calls = _calls(spark, folder)
    found = components(calls.select(F.col("idx").alias("node")), candidate_pairs(calls, _OPEN).select("a", "b"))
    return cut(calls.join(found.select(F.col("node").alias("idx"), F.col("component").alias("group_id")), "idx"))


@query("components_single_linkage", f"WITH RECURSIVE {_COMPONENTS} SELECT node, component FROM comp")
def components_query(spark: SparkSession, folder: str) -> DataFrame:
    return _components(spark, folder)


for _constraint in ("none", "bbox_diameter", "clique", "centroid"):

    @query(f"cluster_{_constraint}")
    def _clusters(spark: SparkSession, folder: str, constraint: str = _constraint) -> DataFrame:
        """Ordered, sample-exclusive clusters; tests hold them to a model without heap and forest."""
        return cluster_calls(_calls(spark, folder), replace(CFG, merge_constraint=constraint))


@query("cluster_intrasample", f"WITH RECURSIVE {_COMPONENTS} SELECT block, idx, group_id FROM mem")
def cluster_intrasample(spark: SparkSession, folder: str) -> DataFrame:
    """Without the sample rule and constraints, ordered clusters are the components."""
    return cluster_calls(_calls(spark, folder), _OPEN)


# --- aggregates --------------------------------------------------------------------------------------------------


@query(
    "group_support",
    f"""WITH RECURSIVE {_COMPONENTS} SELECT block, group_id, CAST(bit_count(bit_or(support_mask)) AS BIGINT) AS supp, CAST(sum(support_calls) AS BIGINT) AS supp_calls,
  array_to_string(list_sort(flatten(list(id_list))), ',') AS ids, count(*) AS n_calls FROM mem GROUP BY 1, 2""",
)
def group_support(spark: SparkSession, folder: str) -> DataFrame:
    return agg.support(_members(spark, folder)).withColumn("ids", F.array_join("ids", ","))


_MOMENTS = """m1 AS (SELECT block, group_id, sum(support_calls * start_mean) / sum(support_calls) AS ms, sum(support_calls * svlen_mean) / sum(support_calls) AS ml FROM mem GROUP BY 1, 2),
m2 AS (SELECT block, group_id, ms, ml, sum(support_calls * (start_variance + (start_mean - ms) * (start_mean - ms))) / sum(support_calls) AS vs,
  sum(support_calls * (svlen_variance + (svlen_mean - ml) * (svlen_mean - ml))) / sum(support_calls) AS vl FROM mem JOIN m1 USING (block, group_id) GROUP BY 1, 2, 3, 4)"""


_RECORD = """rp AS (SELECT block, group_id, id AS rep_id, CAST(s + 1 AS BIGINT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY block, group_id ORDER BY first_sample, id, idx) AS rn FROM mem) WHERE rn = 1),
ci AS (SELECT m2.*, rep_id, pos, CAST(floor(abs(ml) + 0.5) AS BIGINT) AS len, CAST(floor(ms - 1.96 * sqrt(vs) + 0.5) AS BIGINT) - pos AS lo, CAST(floor(ms + 1.96 * sqrt(vs) + 0.5) AS BIGINT) - pos AS hi,
  CAST(floor(ms + abs(ml) - 1.96 * sqrt(vs + vl) + 0.5) AS BIGINT) - pos - CAST(floor(abs(ml) + 0.5) AS BIGINT) AS elo, CAST(floor(ms + abs(ml) + 1.96 * sqrt(vs + vl) + 0.5) AS BIGINT) - pos - CAST(floor(abs(ml) + 0.5) AS BIGINT) AS ehi
  FROM m2 JOIN rp USING (block, group_id))"""


@query(
    "group_moments_ci",
    f"""WITH RECURSIVE {_COMPONENTS}, {_MOMENTS}, {_RECORD} SELECT block, group_id, floor(ms * 100 + 0.5) / 100 AS mean_start, floor(ml * 100 + 0.5) / 100 AS mean_svlen,
  floor(vs * 100 + 0.5) / 100 AS var_start, floor(vl * 100 + 0.5) / 100 AS var_svlen, lo AS ci_low, hi AS ci_high FROM ci""",
)
def group_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Means, variances and the confidence interval of the start around the representative's position."""
    members = _members(spark, folder)
    found = agg.moments(members).join(agg.representatives(members), ["block", "group_id"])
    cents = lambda c: (round_half_up(F.col(c) * 100) / 100).alias(c)
    low, high = agg.interval_offsets(F.col("mean_start"), F.col("var_start"), F.col("pos"))
    return found.select("block", "group_id", *[cents(c) for c in ("mean_start", "mean_svlen", "var_start", "var_svlen")], low.alias("ci_low"), high.alias("ci_high"))


@query(
    "representative_row",
    f"""WITH RECURSIVE {_COMPONENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY block, group_id ORDER BY first_sample, id, idx) AS rn FROM mem)
SELECT block, group_id, idx AS rep_idx, id AS rep_id, CAST(s + 1 AS BIGINT) AS pos FROM r WHERE rn = 1""",
)
def representative_row(spark: SparkSession, folder: str) -> DataFrame:
    return agg.representatives(_members(spark, folder))


@query(
    "claims_consensus",
    f"""WITH RECURSIVE {_COMPONENTS}, c AS (SELECT block, group_id, any_value(bucket) AS k, list_sort(list(DISTINCT svclaim) FILTER (svclaim IS NOT NULL)) AS s, count(*) AS n, count(svclaim) AS c
  FROM mem WHERE bucket IN ('DEL', 'DUP', 'CNV') GROUP BY 1, 2)
SELECT block, group_id, CASE WHEN k <> 'CNV' AND len(s) = 1 AND n = c THEN s[1] END AS svclaim,
  CASE WHEN NOT coalesce(k <> 'CNV' AND len(s) = 1 AND n = c, false) AND len(s) > 0 THEN array_to_string(s, ',') END AS svclaim_set FROM c""",
)
def claims_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return agg.claims(_members(spark, folder)).withColumn("svclaim_set", F.array_join("svclaim_set", ","))


@query(
    "tr_contained",
    f"""WITH RECURSIVE {_COMPONENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY block, group_id ORDER BY first_sample, id, idx) AS rn FROM mem WHERE trid IS NOT NULL)
SELECT block, group_id, trid AS tr_contained FROM r WHERE rn = 1""",
)
def tr_contained(spark: SparkSession, folder: str) -> DataFrame:
    return agg.repeat_of_cluster(_members(spark, folder))


@query(
    "sample_pivot",
    f"""WITH RECURSIVE {_COMPONENTS}, x AS (SELECT m.block, m.group_id, b.i AS sample, m.first_sample, m.id, m.idx FROM mem m JOIN range(0, 64) b(i) ON ((m.support_mask >> b.i) & 1) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY block, group_id, sample ORDER BY first_sample, id, idx) AS rn FROM x)
SELECT block, group_id, CAST(sample AS INTEGER) AS sample, idx FROM r WHERE rn = 1""",
)
def sample_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return agg.sample_cells(_members(spark, folder))


@query("min_supp_having", f"WITH RECURSIVE {_COMPONENTS} SELECT block, group_id, CAST(bit_count(bit_or(support_mask)) AS BIGINT) AS supp FROM mem GROUP BY 1, 2 HAVING bit_count(bit_or(support_mask)) >= 2")
def min_supp_having(spark: SparkSession, folder: str) -> DataFrame:
    return agg.support(_members(spark, folder)).filter("supp >= 2").select("block", "group_id", "supp")


@query("group_size_histogram", f"WITH RECURSIVE {_COMPONENTS}, s AS (SELECT block, group_id, count(*) AS size FROM mem GROUP BY 1, 2) SELECT block, size, count(*) AS n_groups FROM s GROUP BY 1, 2")
def group_size_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return agg.group_sizes(_members(spark, folder))


@query(
    "incremental_merge",
    f"""WITH RECURSIVE {_COMPONENTS}, {_MOMENTS}, n AS (SELECT block, group_id, CAST(sum(support_calls) AS BIGINT) AS w FROM mem GROUP BY 1, 2)
SELECT block, group_id, w AS support_calls, floor(ms * 100 + 0.5) / 100 AS mean, floor(vs * 100 + 0.5) / 100 AS variance FROM m2 JOIN n USING (block, group_id)""",
)
def incremental_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster merged per input file first, then the partial states merged: equals the one-shot moments."""
    members = _members(spark, folder)
    staged = members.select("block", "group_id", "sample_id", "support_calls", F.col("start_mean").alias("mean"), F.col("start_variance").alias("variance"))
    per_file = agg.recombined(staged, ["block", "group_id", "sample_id"])
    both = agg.recombined(per_file, ["block", "group_id"])
    cents = lambda c: (round_half_up(F.col(c) * 100) / 100).alias(c)
    return both.select("block", "group_id", "support_calls", cents("mean"), cents("variance"))


@query(
    "records_intrasample",
    f"""WITH RECURSIVE {_COMPONENTS}, {_MOMENTS}, {_RECORD}, k AS (SELECT block, group_id, any_value(contig) AS contig, any_value(bucket) AS svtype, CAST(bit_count(bit_or(support_mask)) AS BIGINT) AS supp,
  CAST(sum(support_calls) AS BIGINT) AS supp_calls, array_to_string(list_sort(flatten(list(id_list))), ',') AS idlist, list_sort(list(DISTINCT svclaim) FILTER (svclaim IS NOT NULL)) AS cl, count(*) AS n, count(svclaim) AS c,
  arg_min(trid, (first_sample, id, idx)) FILTER (trid IS NOT NULL) AS tr_contained FROM mem GROUP BY 1, 2)
SELECT contig, pos, rep_id AS id, svtype, CAST(CASE WHEN svtype = 'DEL' THEN -len ELSE len END AS INTEGER) AS svlen, CASE WHEN svtype IN ('DEL', 'DUP', 'INV', 'CNV') THEN pos + len END AS stop,
  lo || ',' || hi AS cipos, CASE WHEN svtype IN ('DEL', 'DUP', 'INV', 'CNV') THEN elo || ',' || ehi END AS ciend, supp, supp_calls, idlist,
  CASE WHEN svtype IN ('DEL', 'DUP') AND len(cl) = 1 AND n = c THEN cl[1] END AS svclaim,
  CASE WHEN svtype IN ('DEL', 'DUP', 'CNV') AND NOT coalesce(svtype <> 'CNV' AND len(cl) = 1 AND n = c, false) AND len(cl) > 0 THEN array_to_string(cl, ',') END AS svclaim_set, tr_contained
  FROM k JOIN ci USING (block, group_id)""",
)
def records_intrasample(spark: SparkSession, folder: str) -> DataFrame:
    """Merged records of clusters without the sample rule, which are the components: all that a record holds."""
    calls = _calls(spark, folder)
    members = cut(calls.join(cluster_calls(calls, _OPEN), ["block", "idx"]))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return agg.merged_records(members, _OPEN).select(
        "contig", "pos", "id", "svtype", "svlen", F.col("end").alias("stop"), text("cipos"), text("ciend"), "supp", "supp_calls", text("idlist"), "svclaim", text("svclaim_set"), "tr_contained"
    )


@query(
    "diagnostics_intrasample",
    f"""WITH RECURSIVE {_COMPONENTS}, s AS (SELECT block, group_id, count(*) AS size FROM mem GROUP BY 1, 2)
SELECT 'kd_coord' AS record_type, block, idx, NULL::BIGINT AS group_id, id, s AS x, e AS y, CAST(support_mask AS VARCHAR) AS support_mask, trid, NULL::BIGINT AS group_size, NULL::BIGINT AS n_groups FROM calls
UNION ALL SELECT 'group_variant', block, idx, group_id, id, s, e, CAST(support_mask AS VARCHAR), trid, NULL, NULL FROM mem
UNION ALL SELECT 'group_size_count', block, NULL, NULL, NULL, NULL, NULL, NULL, NULL, size, count(*) FROM s GROUP BY block, size""",
)
def diagnostics_intrasample(spark: SparkSession, folder: str) -> DataFrame:
    """The diagnostics table of those clusters, its texts read back as numbers."""
    calls = _calls(spark, folder)
    whole = lambda c: F.col(c).cast("bigint")
    return diagnostics(calls, cluster_calls(calls, _OPEN)).select(
        "record_type", "block", whole("idx").alias("idx"), whole("group_id").alias("group_id"), "id", F.col("start").cast("double").alias("x"), F.col("end").cast("double").alias("y"),
        "support_mask", "trid", whole("group_size").alias("group_size"), whole("n_groups").alias("n_groups"),
    )


@query("merged_records")
def merged_records(spark: SparkSession, folder: str) -> DataFrame:
    """The whole merge of all calls: clusters under the default settings, one record each."""
    calls = _calls(spark, folder)
    members = cut(calls.join(cluster_calls(calls, CFG), ["block", "idx"]))
    return agg.merged_records(members, CFG)


@query("diagnostics")
def diagnostics_query(spark: SparkSession, folder: str) -> DataFrame:
    """Plane points, cluster members and cluster sizes in one wide table."""
    calls = _calls(spark, folder)
    return diagnostics(calls, cluster_calls(calls, CFG))


@query("merged_lines")
def merged_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The merged records as text lines of a call file."""
    return record_lines(merged_records(spark, folder)).select("contig", "pos", "line")


# --- order -------------------------------------------------------------------------------------------------------


@query(
    "sorted_output",
    """SELECT rec_id, rid, pos0, row_number() OVER (ORDER BY rid, pos0, a, rec_id) AS place FROM (SELECT rec_id, CAST(c.rid AS INTEGER) AS rid, pos0, alleles AS a FROM write_records
  JOIN (SELECT contig, row_number() OVER (ORDER BY added_at, contig) AS rid FROM contigs) c USING (contig))""",
)
def sorted_output(spark: SparkSession, folder: str) -> DataFrame:
    """Global order by contig rank, position and alleles; the place is a running count over range partitions."""
    from callweave.operators.prefix import prefix_scan

    rank = F.row_number().over(Window.orderBy("added_at", "contig"))  # a catalog of contigs: one small partition
    rids = table(spark, folder, "contigs").select("contig", rank.alias("rid"))
    rows = table(spark, folder, "write_records").join(rids, "contig").select("rec_id", "rid", "pos0", "alleles", F.lit(1).alias("one"), F.lit("").alias("all"))
    placed = prefix_scan(rows, ["all"], ["rid", "pos0", "alleles", "rec_id"], {"place": ("sum", "one")})
    return placed.select("rec_id", "rid", "pos0", "place")


# --- breakends ---------------------------------------------------------------------------------------------------

_BND = """live AS (SELECT DISTINCT ON (vcf_id, id) * FROM breakends WHERE deleted_at IS NULL AND id IS NOT NULL ORDER BY vcf_id, id, loaded_at DESC, rec_id DESC),
pr AS (SELECT a.*, b.rec_id AS b_rec, b.contig AS b_contig, b.pos0 AS b_pos0, b.id AS b_id, b.mate_contig AS b_mate_contig, b.mate_pos0 AS b_mate_pos0, b.homlen AS b_homlen, b.gts AS b_gts,
  b.support_calls AS b_support, b.strands AS b_strands, b.inv_event_id AS b_inv, b.inv_filter AS b_flag FROM live a JOIN live b ON a.vcf_id = b.vcf_id AND a.mate_id = b.id AND b.mate_id = a.id
  WHERE (a.contig, a.pos0, a.id) < (b.contig, b.pos0, b.id)),
jd AS (SELECT *, CASE WHEN mate_contig <> b_contig OR b_mate_contig <> contig THEN 'contig'
  WHEN NOT list_contains([0, coalesce(homlen, 0), coalesce(b_homlen, 0)], abs(mate_pos0 - b_pos0)) OR NOT list_contains([0, coalesce(homlen, 0), coalesce(b_homlen, 0)], abs(b_mate_pos0 - pos0)) THEN 'position'
  WHEN gts IS DISTINCT FROM b_gts THEN 'genotype' WHEN support_calls IS DISTINCT FROM b_support THEN 'support' END AS reason FROM pr)"""


def _live(spark: SparkSession, folder: str) -> DataFrame:
    return mates.current_breakends(table(spark, folder, "breakends"))


@query("bnd_pairing", f"WITH {_BND} SELECT rec_id AS a_rec_id, b_rec AS b_rec_id, reason FROM jd")
def bnd_pairing(spark: SparkSession, folder: str) -> DataFrame:
    return mates.paired(_live(spark, folder)).select("a_rec_id", "b_rec_id", "reason")


@query("bnd_orphans", f"WITH {_BND} SELECT rec_id FROM live a WHERE NOT EXISTS (SELECT 1 FROM live b WHERE a.vcf_id = b.vcf_id AND a.mate_id = b.id AND b.mate_id = a.id)")
def bnd_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return mates.orphans(_live(spark, folder)).select("rec_id")


@query("bnd_ambiguous", "SELECT vcf_id, mate_id, count(*) AS n_claims FROM breakends WHERE mate_id IS NOT NULL AND mate_id <> '.' GROUP BY 1, 2 HAVING count(*) > 1")
def bnd_ambiguous(spark: SparkSession, folder: str) -> DataFrame:
    """Mates claimed more than once, among all deliveries."""
    return mates.ambiguous(table(spark, folder, "breakends"))


@query("bnd_canonical", f"WITH {_BND} SELECT least(rec_id, b_rec) AS idx, concat_ws('_', contig, b_contig, 'TRA', strands, b_strands) AS block, CAST(pos0 AS DOUBLE) AS start, CAST(mate_pos0 AS DOUBLE) AS \"end\", id || '/' || b_id AS id FROM jd WHERE reason IS NULL")
def bnd_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return mates.events(mates.paired(_live(spark, folder))).select("idx", "block", "start", "end", "id")


@query("bnd_block_counts", f"WITH {_BND} SELECT concat_ws('_', contig, b_contig, 'TRA', strands, b_strands) AS block, count(*) AS n_events FROM jd WHERE reason IS NULL GROUP BY 1")
def bnd_block_counts(spark: SparkSession, folder: str) -> DataFrame:
    return mates.events(mates.paired(_live(spark, folder))).groupBy("block").agg(F.count("*").alias("n_events"))


@query(
    "bnd_plane_point",
    """SELECT rec_id, CASE WHEN contig > mate_contig OR (contig = mate_contig AND pos0 > mate_pos0) THEN mate_pos0 ELSE pos0 END::DOUBLE AS x,
  CASE WHEN contig > mate_contig OR (contig = mate_contig AND pos0 > mate_pos0) THEN pos0 ELSE mate_pos0 END::DOUBLE AS y FROM breakends WHERE contig IS NOT NULL AND mate_contig IS NOT NULL""",
)
def bnd_plane_point(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "breakends").filter(F.col("contig").isNotNull() & F.col("mate_contig").isNotNull())
    point = notation.plane_point(F.col("contig"), F.col("pos0"), F.col("mate_contig"), F.col("mate_pos0"))
    return rows.select("rec_id", point["start"].alias("x"), point["end"].alias("y"))


_ALT = """CASE strands WHEN '+-' THEN '[' || mate_contig || ':' || (mate_pos0 + 1) || '[N' WHEN '--' THEN ']' || mate_contig || ':' || (mate_pos0 + 1) || ']N'
  WHEN '++' THEN 'N[' || mate_contig || ':' || (mate_pos0 + 1) || '[' WHEN '-+' THEN 'N]' || mate_contig || ':' || (mate_pos0 + 1) || ']' END"""


@query("bnd_alt_round_trip", f"SELECT rec_id, {_ALT} AS alt, mate_contig AS contig, mate_pos0 AS pos0, strands AS orientation FROM breakends WHERE mate_contig IS NOT NULL AND mate_pos0 IS NOT NULL AND strands IS NOT NULL")
def bnd_alt_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """ALT alleles written from mates and orientation, and parsed back."""
    rows = table(spark, folder, "breakends").filter(F.col("mate_contig").isNotNull() & F.col("mate_pos0").isNotNull() & F.col("strands").isNotNull())
    alt = rows.select("rec_id", notation.alt_allele(F.col("mate_contig"), F.col("mate_pos0") + 1, F.col("strands"), F.lit("N")).alias("alt"))
    a = F.col("alt")
    return alt.select("rec_id", "alt", notation.mate_contig(a).alias("contig"), notation.mate_pos0(a).alias("pos0"), notation.strands(a).alias("orientation"))


_EVENTS = """ev AS (SELECT concat_ws('_', contig, b_contig, 'TRA', strands, b_strands) AS block, contig AS ac, b_contig AS bc, strands AS ast, b_strands AS bst, pos0 + 1 AS ap, mate_pos0 + 1 AS bp, vcf_id,
  coalesce(support_calls, 1) AS w, [id, b_id] AS ids, CASE WHEN inv_event_id = b_inv AND inv_filter AND b_flag THEN inv_event_id END AS inv FROM jd WHERE reason IS NULL),
g AS (SELECT block, ap, bp, any_value(ac) AS ac, any_value(bc) AS bc, any_value(ast) AS ast, any_value(bst) AS bst, count(DISTINCT vcf_id) AS supp, CAST(sum(w) AS BIGINT) AS supp_calls,
  array_to_string(list_sort(flatten(list(ids))), '|') AS idl, CASE WHEN min(inv) = max(inv) AND count(inv) = count(*) THEN min(inv) END AS inversion FROM ev GROUP BY 1, 2, 3),
n AS (SELECT *, coalesce(inversion, concat_ws('_', 'ev', ac, ap, bc, bp, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(idl) + 1), lambda i: ascii(substr(idl, i, 1))::BIGINT)), lambda h, c: (h * 17 + c) % 1000000007))) AS event FROM g),
r AS (SELECT *, 'A' AS own, 'B' AS other, ac AS contig, ap AS pos, bc AS mc, bp AS mp, ast AS strands FROM n UNION ALL SELECT *, 'B', 'A', bc, bp, ac, ap, bst FROM n)"""


@query(
    "bnd_records",
    f"""WITH {_BND}, {_EVENTS} SELECT contig, pos, event || '_' || own AS id, event || '_' || other AS mate_id, mc AS mate_contig, 'N' AS ref,
  CASE strands WHEN '+-' THEN '[' || mc || ':' || mp || '[N' WHEN '--' THEN ']' || mc || ':' || mp || ']N' WHEN '++' THEN 'N[' || mc || ':' || mp || '[' WHEN '-+' THEN 'N]' || mc || ':' || mp || ']' END AS alt,
  strands, '0,0' AS cipos, supp, supp_calls, replace(idl, '|', ',') AS idlist, event, CASE WHEN inversion IS NOT NULL THEN 'INV' END AS eventtype FROM r""",
)
def bnd_records(spark: SparkSession, folder: str) -> DataFrame:
    """Two records for each set of events at the very same two places."""
    found = cut(mates.events(mates.paired(_live(spark, folder))))
    place = ["block", "start", "end"]
    same = found.groupBy(*place).agg(F.min("idx").alias("group_id"))
    made = mates.merged_events(found, found.select("idx", *place).join(same, place))
    text = lambda c, mark=",": F.array_join(F.col(c).cast("array<string>"), mark).alias(c)
    return made.select("contig", "pos", "id", "mate_id", "mate_contig", "ref", "alt", "strands", text("cipos"), "supp", "supp_calls", text("idlist"), "event", "eventtype")


@query("bnd_merged")
def bnd_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Breakend events of all files, clustered and written as two records each."""
    found = mates.events(mates.paired(_live(spark, folder)))
    return mates.merged_events(found, cluster_calls(mates.as_calls(found, CFG.max_dist), CFG))
