"""p5: the five nearest points of every point of the clustering plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.neighbours import nearest_points, nearest_vectors
from callweave.llm.registry import query
from callweave.session import table

K = 5
_P5 = """
WITH p AS (SELECT point_id, block_key, x, y FROM plane_points WHERE isfinite(x) AND isfinite(y)),
n AS (SELECT a.point_id AS a, b.point_id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d,
  row_number() OVER (PARTITION BY a.point_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.point_id) AS rk
  FROM p a JOIN p b ON a.block_key = b.block_key AND a.point_id <> b.point_id)
"""


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_points(table(spark, folder, "plane_points"), "point_id", "block_key", "x", "y", K)


@query("p5_found", _P5 + "SELECT DISTINCT least(a, b) AS point_id_a, greatest(a, b) AS point_id_b FROM n WHERE rk <= 5")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    near = _nearest(spark, folder)
    pair = [F.least("point", "neighbour").alias("point_id_a"), F.greatest("point", "neighbour").alias("point_id_b")]
    return near.select(*pair).distinct()


@query("p5_nearest", _P5 + "SELECT a AS point, b AS neighbour, CAST(rk AS INTEGER) AS rank, d AS distance FROM n WHERE rk <= 5 AND a % 100 = 0")
def p5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours and distances of the query points (ids divisible by 100), against all points."""
    return _nearest(spark, folder).filter(F.col("point") % 100 == 0)


@query("p5_vectors")
def p5_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest embeddings of each embedding whose id is divisible by 100, against all; approximate."""
    rows = table(spark, folder, "embeddings")
    return nearest_vectors(rows, "vec_id", "embedding", 10, rows.filter(F.col("vec_id") % 100 == 0))
