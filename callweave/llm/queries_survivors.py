"""p1: the best record of each duplicate group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.registry import query
from callweave.llm.survivors import Bundle, _finite, aggregate_survivors
from callweave.session import table

_P1 = """
WITH m AS (SELECT g.*, list_sort(list_distinct(list_filter(list_transform(id_list, lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))),
    lambda x: x IS NOT NULL AND x <> ''))) AS ids FROM group_aggregates g),
k AS (SELECT m.*, r.trust_level AS trust, min(rec_id) OVER (PARTITION BY ids) AS first_rec_id, count(*) OVER (PARTITION BY ids) AS n
  FROM m LEFT JOIN merge_runs r USING (run_id) WHERE len(ids) > 0),
f AS (SELECT first_rec_id, 'start_sum' AS field_name, rec_id, trust, emitted_at, start_sum AS v FROM k WHERE n > 1 AND isfinite(start_sum)
  UNION ALL SELECT first_rec_id, 'svlen_sum', rec_id, trust, emitted_at, svlen_sum FROM k WHERE n > 1 AND isfinite(svlen_sum)
  UNION ALL SELECT first_rec_id, 'support_calls', rec_id, trust, emitted_at, support_calls FROM k WHERE n > 1 AND support_calls >= 1),
b AS (SELECT *, row_number() OVER (PARTITION BY first_rec_id, field_name
  ORDER BY trust DESC NULLS LAST, emitted_at DESC NULLS LAST, rec_id) AS rn FROM f)
"""


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "group_aggregates"), table(spark, folder, "merge_runs")


@query("p1_found", _P1 + "SELECT first_rec_id, field_name, rec_id FROM b WHERE rn = 1")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate_survivors(*_tables(spark, folder))


@query("p1_values", _P1 + "SELECT first_rec_id, max(CASE WHEN field_name = 'start_sum' THEN v END) AS start_sum, max(CASE WHEN field_name = 'svlen_sum' THEN v END) AS svlen_sum, CAST(max(CASE WHEN field_name = 'support_calls' THEN v END) AS BIGINT) AS support_calls FROM b WHERE rn = 1 GROUP BY 1")
def p1_values(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving values, one row per group."""
    records, runs = _tables(spark, folder)
    best = aggregate_survivors(records, runs)
    values = records.select("rec_id", "start_sum", "svlen_sum", "support_calls")
    pick = lambda c: F.max(F.when(F.col("field_name") == c, F.col(c))).alias(c)
    return best.join(values, "rec_id").groupBy("first_rec_id").agg(pick("start_sum"), pick("svlen_sum"), pick("support_calls"))


@query("p1_bundles")
def p1_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Positions as one bundle (start and end together), on which length depends; support stays free."""
    place = Bundle("place", ("start_sum", "end_sum"), _finite("start_sum") & _finite("end_sum"))
    length = Bundle("length", ("svlen_sum",), _finite("svlen_sum"))
    support = Bundle("support", ("support_calls",), F.coalesce(F.col("support_calls") >= 1, F.lit(False)))
    return aggregate_survivors(*_tables(spark, folder), [("place", "length")], [place, length, support])
