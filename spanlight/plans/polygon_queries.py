"""Queries of polygon unions."""

from pyspark.sql import functions as F

from ..operators import polygons as p
from .registry import query

BOX_COLUMNS = ("s_suppkey AS id", "s_acctbal AS x1", "CAST((s_suppkey * 7919) % 1009 AS DOUBLE) * 10 AS y1", "round(s_acctbal + 200 + (s_suppkey * 37) % 700, 2) AS x2", "CAST((s_suppkey * 7919) % 1009 AS DOUBLE) * 10 + 150 + (s_suppkey * 53) % 600 AS y2")
BOXES = f"b AS (SELECT {', '.join(BOX_COLUMNS)} FROM supplier)"


def box_polygons(spark, sf):
    """A box of each supplier as a ring, every other one turning right."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(at("x1", "y1"), at("x2", "y1"), at("x2", "y2"), at("x1", "y2"))
    b = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr(*BOX_COLUMNS)
    return b.select("id", F.when(F.col("id") % 2 == 0, ring).otherwise(F.reverse(ring)).alias("ring"))


@query("u7_union_corners", f"""WITH {BOXES}, xs AS (SELECT x1 AS x FROM b UNION SELECT x2 FROM b), ys AS (SELECT y1 AS y FROM b UNION SELECT y2 FROM b),
q AS (SELECT x, y, (SELECT count(*) > 0 FROM b WHERE x1 <= x AND x < x2 AND y1 <= y AND y < y2) AS ne, (SELECT count(*) > 0 FROM b WHERE x1 < x AND x <= x2 AND y1 <= y AND y < y2) AS nw,
 (SELECT count(*) > 0 FROM b WHERE x1 <= x AND x < x2 AND y1 < y AND y <= y2) AS se, (SELECT count(*) > 0 FROM b WHERE x1 < x AND x <= x2 AND y1 < y AND y <= y2) AS sw FROM xs, ys)
SELECT round(x, 2) AS x, round(y, 2) AS y FROM q WHERE (ne::INT + nw::INT + se::INT + sw::INT) % 2 = 1 OR (ne = sw AND nw = se AND ne <> nw)""")
def u7_corners(spark, sf):
    """The places at which the rings of the union of all boxes turn."""
    found = p.corners(p.union(box_polygons(spark, sf)))
    return found.select(F.round("x", 2).alias("x"), F.round("y", 2).alias("y")).distinct()


@query("u7_union_area", f"""WITH {BOXES}, xs AS (SELECT DISTINCT unnest([x1, x2]) AS x FROM b), ys AS (SELECT DISTINCT unnest([y1, y2]) AS y FROM b),
i AS (SELECT x, lead(x) OVER (ORDER BY x) AS x_ FROM xs), j AS (SELECT y, lead(y) OVER (ORDER BY y) AS y_ FROM ys)
SELECT round(sum((x_ - x) * (y_ - y)), 1) AS area FROM i, j WHERE EXISTS (SELECT 1 FROM b WHERE x1 <= x AND x_ <= x2 AND y1 <= y AND y_ <= y2)""")
def u7_area(spark, sf):
    """The area of the union, holes taken off."""
    return p.ring_areas(p.union(box_polygons(spark, sf))).agg(F.round(F.sum("area"), 1).alias("area"))


@query("u7_simplified_rings")
def u7_simplified(spark, sf):
    """Boxes without corners that lie near one kept before; tested on known rings."""
    return box_polygons(spark, sf).select("id", F.size(p.simplified(F.col("ring"), 300.0)).alias("n"))
