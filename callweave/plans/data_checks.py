"""Queries p2, p3 and p4: rows that fail to parse, broken references, heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators.heavy import heavy_keys, per_key, per_key_distinct
from callweave.operators.ingest import load_catalog, rejected_rows, valid_rows
from callweave.operators.references import breakend_references, reference_counts
from callweave.plans.registry import query
from callweave.session import table

_P2 = r"""
WITH l AS (SELECT line_id, coalesce(raw_line, '') AS t FROM tr_catalog_raw),
q AS (SELECT line_id, t, length(t) - length(replace(t, '"', '')) AS quotes,
  regexp_matches(t, '(?s)^[ \t\r]*[^ \t\r"]+[ \t\r]+[^ \t\r"]+[ \t\r]+[^ \t\r"]+[ \t\r]+"[^"]*"([ \t\r][^"]*)?$') AS paired FROM l),
c AS (SELECT line_id, quotes, paired,
  CASE WHEN quotes = 0 THEN list_filter(regexp_split_to_array(t, '[ \t\r]+'), lambda x: x <> '')
       WHEN paired THEN list_concat(list_concat(
         list_filter(regexp_split_to_array(regexp_extract(t, '(?s)^([^"]*)"', 1), '[ \t\r]+'), lambda x: x <> ''),
         [regexp_extract(t, '(?s)"([^"]*)"', 1)]),
         list_filter(regexp_split_to_array(regexp_extract(t, '(?s)"[^"]*"([^"]*)$', 1), '[ \t\r]+'), lambda x: x <> ''))
       ELSE [] END AS f FROM q),
i AS (SELECT *, f[1] AS chrom, f[2] AS s, f[3] AS e, string_split(f[4], ';') AS items FROM c),
n AS (SELECT *, list_transform(items, lambda x: split_part(x, '=', 1)) AS names,
  list_filter(items, lambda x: starts_with(x, 'MOTIFS='))[1] AS m FROM i),
r AS (SELECT *, CASE
  WHEN quotes > 0 AND NOT paired THEN 'bad_quote'
  WHEN len(f) <> 4 THEN 'column_count'
  WHEN NOT regexp_full_match(s, '[0-9]+') OR length(ltrim(s, '0')) > 10 OR coalesce(TRY_CAST(s AS HUGEINT), 99999999999) > 4294967295 THEN 'bad_start'
  WHEN NOT regexp_full_match(e, '[0-9]+') OR length(ltrim(e, '0')) > 10 OR coalesce(TRY_CAST(e AS HUGEINT), 99999999999) > 4294967295 THEN 'bad_end'
  WHEN len(list_filter(items, lambda x: NOT regexp_full_match(x, '(?s)[^=]+=.+'))) > 0 THEN 'bad_info'
  WHEN len(list_distinct(names)) < len(names) THEN 'duplicate_name'
  WHEN NOT list_contains(names, 'ID') THEN 'missing_id'
  WHEN NOT list_contains(names, 'MOTIFS') THEN 'missing_motifs'
  WHEN NOT regexp_full_match(substr(m, 8), '[ACGTNacgtn]+(,[ACGTNacgtn]+)*') THEN 'bad_motif' END AS reason FROM n)
"""


def _catalog(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    return load_catalog(table(spark, folder, "tr_catalog_raw"), "raw_line", keep)


@query("p2_found", _P2 + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejected_rows(_catalog(spark, folder, "line_id")).select("line_id", "reason")


@query(
    "p2_loaded",
    _P2
    + """SELECT line_id, chrom, CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos,
  substr(list_filter(items, lambda x: starts_with(x, 'ID='))[1], 4) AS tr_id,
  CAST(list_min(list_transform(string_split(substr(m, 8), ','), lambda x: length(x))) AS INTEGER) AS motif_len
  FROM r WHERE reason IS NULL""",
)
def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that load, with TrId.id and motif_len."""
    return valid_rows(_catalog(spark, folder, "line_id")).drop("motifs")


@query(
    "p2_reasons",
    _P2
    + """SELECT file_name, reason, count(*) AS n_lines FROM r JOIN tr_catalog_raw USING (line_id)
  WHERE reason IS NOT NULL GROUP BY 1, 2""",
)
def p2_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected lines per file and reason."""
    return rejected_rows(_catalog(spark, folder, "file_name")).groupBy("file_name", "reason").agg(F.count("*").alias("n_lines"))


_P3 = """
WITH m AS (SELECT b.rec_id, b.loaded_at, 'mate_id' AS field_name, CASE
    WHEN count(t.rec_id) = 0 THEN 'missing'
    WHEN bool_or(t.loaded_at <= b.loaded_at AND (t.deleted_at IS NULL OR t.deleted_at > b.loaded_at)) THEN NULL
    WHEN bool_or(t.loaded_at > b.loaded_at) THEN 'late' ELSE 'deleted' END AS status
  FROM breakends b LEFT JOIN breakends t ON t.vcf_id = b.vcf_id AND t.id = b.mate_id
  WHERE b.mate_id IS NOT NULL AND b.mate_id <> '.' GROUP BY b.rec_id, b.loaded_at),
c AS (SELECT b.rec_id, b.loaded_at, 'mate_contig' AS field_name, CASE
    WHEN c.contig IS NULL THEN 'missing' WHEN c.added_at > b.loaded_at THEN 'late'
    WHEN c.retired_at <= b.loaded_at THEN 'deleted' END AS status
  FROM breakends b LEFT JOIN contigs c ON c.contig = b.mate_contig WHERE b.mate_contig IS NOT NULL),
u AS (SELECT * FROM m WHERE status IS NOT NULL UNION ALL SELECT * FROM c WHERE status IS NOT NULL)
"""


def _broken(spark: SparkSession, folder: str) -> DataFrame:
    return breakend_references(table(spark, folder, "breakends"), table(spark, folder, "contigs"))


@query("p3_found", _P3 + "SELECT rec_id, field_name, status FROM u")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _broken(spark, folder).select("rec_id", "field_name", "status")


@query(
    "p3_counts",
    _P3
    + """SELECT 'breakends' AS table_name, field_name, strftime(loaded_at, '%Y-%m') AS period, status,
  count(*) AS n_refs FROM u GROUP BY 2, 3, 4""",
)
def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Broken references per table, field, month and state."""
    return reference_counts(_broken(spark, folder), "breakends")


HEAVY_SHARE = 0.03


@query(
    "p4_found",
    """SELECT contig, variant_type FROM sv_calls WHERE contig IS NOT NULL GROUP BY 1, 2
  HAVING count(*) > 0.03 * (SELECT count(*) FROM sv_calls)""",
)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(table(spark, folder, "sv_calls"), ["contig", "variant_type"], HEAVY_SHARE).select("contig", "variant_type")


@query(
    "p4_blocks",
    """SELECT contig, variant_type, count(*) AS n_rows, count(DISTINCT call_id) AS n_calls, sum(support_calls)::BIGINT AS support_calls,
  min(start_pos) AS first_start, max(start_pos) AS last_start, sum(abs(svlen)) AS total_len, min(svlen_mean) AS least_len_mean,
  bit_or(support_mask) AS support_mask, sum(CASE WHEN trid IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_in_repeats
  FROM sv_calls GROUP BY 1, 2""",
)
def p4_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Results per block of calls; every aggregate is a mergeable state, the distinct count goes in two steps."""
    calls, keys = table(spark, folder, "sv_calls"), ["contig", "variant_type"]
    plain = per_key(
        calls,
        keys,
        [
            F.count("*").alias("n_rows"),
            F.sum("support_calls").alias("support_calls"),
            F.min("start_pos").alias("first_start"),
            F.max("start_pos").alias("last_start"),
            F.sum(F.abs("svlen")).alias("total_len"),
            F.min("svlen_mean").alias("least_len_mean"),
            F.bit_or("support_mask").alias("support_mask"),
            F.sum(F.when(F.col("trid").isNotNull(), 1).otherwise(0)).alias("n_in_repeats"),
        ],
    )
    distinct = per_key_distinct(calls, keys, "call_id", "n_calls").select(F.col("contig").alias("_c"), F.col("variant_type").alias("_v"), "n_calls")
    same = plain["contig"].eqNullSafe(distinct["_c"]) & plain["variant_type"].eqNullSafe(distinct["_v"])
    return plain.join(distinct, same, "left").select(*plain.columns, F.coalesce("n_calls", F.lit(0)).cast("bigint").alias("n_calls"))
