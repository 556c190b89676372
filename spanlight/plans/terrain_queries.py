"""Queries of triangulated terrain."""

from pyspark.sql import functions as F

from ..operators import terrain as t
from ..sources.points import GROUND, KEY, points
from .registry import query

PLACES = "s AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST((s_suppkey * 7919) % 1009 AS DOUBLE) * 10 AS y FROM supplier)"
TRIPLES = """t AS (SELECT a.id AS a, b.id AS b, c.id AS c, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn
  FROM s a JOIN s b ON a.id < b.id JOIN s c ON b.id < c.id)"""
#: Above 0 if d lies in the circle of a, b, c, where these turn left.
IN_CIRCLE = """((ax - d.x) * (ax - d.x) + (ay - d.y) * (ay - d.y)) * ((bx - d.x) * (cy - d.y) - (cx - d.x) * (by_ - d.y))
  + ((bx - d.x) * (bx - d.x) + (by_ - d.y) * (by_ - d.y)) * ((cx - d.x) * (ay - d.y) - (ax - d.x) * (cy - d.y))
  + ((cx - d.x) * (cx - d.x) + (cy - d.y) * (cy - d.y)) * ((ax - d.x) * (by_ - d.y) - (bx - d.x) * (ay - d.y))"""


@query("r1_triangulation", f"WITH {PLACES}, {TRIPLES}, inside AS (SELECT DISTINCT t.a, t.b, t.c FROM t, s d WHERE d.id NOT IN (t.a, t.b, t.c) AND sign(turn) * ({IN_CIRCLE}) > 0) SELECT a, b, c, round(abs(turn) / 2, 3) AS area FROM t ANTI JOIN inside USING (a, b, c) WHERE turn <> 0")
def r1_triangulation(spark, sf):
    """The triangles of the suppliers' places, by their keys, in tiles of 30 points."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_acctbal AS x", "CAST((s_suppkey * 7919) % 1009 AS DOUBLE) * 10 AS y", "CAST(s_suppkey AS DOUBLE) AS z")
    found = t.triangulation(s, 30)
    ids = F.array_sort(F.array(*[F.col(f"{k}.z").cast("long") for k in "abc"]))
    turn = (F.col("b.x") - F.col("a.x")) * (F.col("c.y") - F.col("a.y")) - (F.col("b.y") - F.col("a.y")) * (F.col("c.x") - F.col("a.x"))
    return found.select(*[ids[i].alias(k) for i, k in enumerate("abc")], F.round(F.abs(turn) / 2, 3).alias("area"))


@query("r1_terrain")
def r1_terrain(spark, sf):
    """The raster of all ground points' triangles; tested against one triangulation and on known surfaces."""
    return t.terrain(points(spark, sf).where(F.col("seg_type") == GROUND), 5.0)


@query("p2_heights_above_triangles")
def p2_heights(spark, sf):
    """Heights of all points above the triangulated terrain."""
    return t.normalised(points(spark, sf), GROUND, 0.5, 5.0).select(*KEY, F.round("hag", 6).alias("hag"))
