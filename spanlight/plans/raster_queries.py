"""Queries of raster operators."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import raster as r
from ..sources.points import KEY, P, points
from .filter_queries import K
from .graph_queries import CLOSURE_2D
from .registry import query

M = "m AS (SELECT DISTINCT CAST(floor(x / 20.0) AS BIGINT) AS cx, CAST(floor(y / 20.0) AS BIGINT) AS cy FROM p WHERE {0})"
ERODE = "{1} AS (SELECT a.cx, a.cy FROM (SELECT DISTINCT m.cx + i AS cx, m.cy + j AS cy FROM {0} m, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) a JOIN {0} b ON abs(b.cx - a.cx) <= 1 AND abs(b.cy - a.cy) <= 1 GROUP BY 1, 2 HAVING count(*) = 9)"
DILATE = "{1} AS (SELECT DISTINCT m.cx + i AS cx, m.cy + j AS cy FROM {0} m, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j))"


def mask(spark, sf, where):
    return points(spark, sf).where(where).select(F.floor(F.col("x") / 20.0).alias("cx"), F.floor(F.col("y") / 20.0).alias("cy")).distinct()


@query("r9_opened_mask", f"WITH {P}, {M.format('seg_type = 1')}, {ERODE.format('m', 'e')}, {DILATE.format('e', 'd')} SELECT cx, cy FROM d")
def r9_open(spark, sf):
    return r.opened(mask(spark, sf, "seg_type = 1"), 3)


@query("r9_closed_mask", f"WITH {P}, {M.format('seg_type = 4')}, {DILATE.format('m', 'd')}, {ERODE.format('d', 'e')} SELECT cx, cy FROM e")
def r9_close(spark, sf):
    return r.closed(mask(spark, sf, "seg_type = 4"), 3)


@query("f20_morphed_points", f"WITH {P}, {M.format('seg_type = 1')}, {ERODE.format('m', 'e')}, {DILATE.format('e', 'd')}, {DILATE.format('d', 'f')} SELECT {K} FROM p WHERE seg_type = 1 AND EXISTS (SELECT 1 FROM f WHERE f.cx = floor(x / 20.0) AND f.cy = floor(y / 20.0))")
def f20(spark, sf):
    return r.morphed_points(points(spark, sf).where("seg_type = 1"), 20.0, 3).select(*KEY)


COMPONENTS = "k AS (SELECT row_number() OVER (ORDER BY cx, cy) AS id, cx AS x, cy AS y FROM m), " + CLOSURE_2D.format("")


@query("r10_without_small_areas", f"WITH RECURSIVE {P}, {M.format('seg_type = 15')}, {COMPONENTS}, b AS (SELECT component FROM l GROUP BY component HAVING count(*) * 400.0 >= 1600) SELECT k.x AS cx, k.y AS cy FROM l JOIN k USING (id) WHERE component IN (SELECT component FROM b)")
def r10(spark, sf):
    return r.without_small(mask(spark, sf, "seg_type = 15"), 20.0, 1600.0)


@query("u3_touching_components", f"WITH RECURSIVE {P}, {M.format('seg_type = 15')}, {M.format('seg_type = 2').replace('m AS', 'o AS')}, {COMPONENTS}, h AS (SELECT DISTINCT component FROM l JOIN k USING (id) JOIN o ON o.cx = k.x AND o.cy = k.y) SELECT k.x AS cx, k.y AS cy FROM l JOIN k USING (id) WHERE component IN (SELECT component FROM h)")
def u3(spark, sf):
    return r.touching(mask(spark, sf, "seg_type = 15"), mask(spark, sf, "seg_type = 2"))


@query("r5_hough_votes", f"WITH {P}, {M.format('seg_type = 4')}, t AS (SELECT CAST(unnest(range(0, 36)) AS INT) AS t) SELECT t, CAST(floor((cx * cos(t * pi() / 36) + cy * sin(t * pi() / 36)) + 0.5) AS BIGINT) AS rho, count(*) AS votes FROM m CROSS JOIN t GROUP BY 1, 2 HAVING count(*) > 5")
def r5(spark, sf):
    return r.hough(mask(spark, sf, "seg_type = 4"), 36).where("votes > 5")


@query("r8_shapeness", f"WITH RECURSIVE {P}, {M.format('seg_type = 15')}, {COMPONENTS}, f AS (SELECT l.component, count(*) AS perimeter FROM l JOIN k USING (id), (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(ox, oy) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.cx = k.x + ox AND m.cy = k.y + oy) GROUP BY 1), a AS (SELECT component, count(*) AS area FROM l GROUP BY component) SELECT area, perimeter, count(*) AS n FROM a JOIN f USING (component) GROUP BY 1, 2")
def r8(spark, sf):
    return r.shapeness(mask(spark, sf, "seg_type = 15")).groupBy("area", "perimeter").agg(F.count(F.lit(1)).alias("n"))


@query("r2_road_mask", "WITH s AS (SELECT s_suppkey, s_acctbal / 50.0 AS x1, CAST(s_suppkey % 90 AS DOUBLE) AS y1, s_acctbal / 50.0 + s_nationkey AS x2, CAST(s_suppkey % 90 AS DOUBLE) + 15 AS y2 FROM supplier), g AS (SELECT *, unnest(range(CAST(floor((least(x1, x2) - 3) / 2) AS BIGINT), CAST(floor((greatest(x1, x2) + 3) / 2) AS BIGINT) + 1)) AS cx FROM s), h AS (SELECT *, unnest(range(CAST(floor((least(y1, y2) - 3) / 2) AS BIGINT), CAST(floor((greatest(y1, y2) + 3) / 2) AS BIGINT) + 1)) AS cy FROM g), t AS (SELECT *, greatest(0, least(1, (((cx + 0.5) * 2 - x1) * (x2 - x1) + ((cy + 0.5) * 2 - y1) * (y2 - y1)) / ((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)))) AS t FROM h) SELECT DISTINCT cx, cy FROM t WHERE ((cx + 0.5) * 2 - x1 - t * (x2 - x1)) ** 2 + ((cy + 0.5) * 2 - y1 - t * (y2 - y1)) ** 2 <= 9")
def r2(spark, sf):
    roads = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_acctbal / 50.0D AS x1", "CAST(s_suppkey % 90 AS DOUBLE) AS y1", "s_acctbal / 50.0D + s_nationkey AS x2", "CAST(s_suppkey % 90 AS DOUBLE) + 15 AS y2")
    return r.road_mask(roads, 2.0, 3.0)


@query("r12_pseudo_colours", f"WITH {P}, t AS (SELECT {K}, greatest(0, least(1, (z - 10) / 80.0)) AS t FROM p) SELECT {K}, CAST(round(greatest(0, 2 * t - 1) * 255) AS INT) AS r, CAST(round(greatest(0, 1 - abs(2 * t - 1)) * 255) AS INT) AS g, CAST(round(greatest(0, 1 - 2 * t) * 255) AS INT) AS b FROM t")
def r12(spark, sf):
    return points(spark, sf).select(*KEY, r.pseudo_colour(F.col("z"), 10.0, 90.0).alias("c")).select(*KEY, "c.*")


@query("s15_band_statistics", f"WITH {P}, b AS (SELECT floor(x / 20.0) AS cx, floor(y / 20.0) AS cy, CASE WHEN min(z) < 4 THEN -9999 ELSE min(z) END AS value FROM p GROUP BY 1, 2) SELECT min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, count(*) AS n FROM b WHERE value > -9990")
def s15(spark, sf):
    b = points(spark, sf).groupBy(F.floor(F.col("x") / 20.0).alias("cx"), F.floor(F.col("y") / 20.0).alias("cy")).agg(F.min("z").alias("value")).withColumn("value", F.when(F.col("value") < 4, -9999.0).otherwise(F.col("value")))
    return r.band_statistics(b, -9990.0).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("g10_pixel_to_world", f"WITH {P} SELECT {K}, 100 + r * 0.5 + g * 0.1 AS wx, 200 + r * 0.2 - g * 0.5 AS wy FROM p")
def g10(spark, sf):
    return points(spark, sf).select(*KEY, g.affine(F.col("r"), F.col("g"), (100, 0.5, 0.1, 200, 0.2, -0.5)).alias("w")).select(*KEY, F.col("w.x").alias("wx"), F.col("w.y").alias("wy"))
