"""Queries of stencils, islands and ordered computations."""

from pyspark.sql import Window, functions as F

from ..functions import geometry as g
from ..operators import windows as w
from ..sources.points import E, KEY, P, cloud, points
from .filter_queries import K
from .registry import query

R = "r AS (SELECT CAST(floor(x / 20.0) AS BIGINT) AS cx, CAST(floor(y / 20.0) AS BIGINT) AS cy, {0}(z) AS value FROM p GROUP BY 1, 2)"


def raster(spark, sf, f=F.min, size=20.0):
    return points(spark, sf).groupBy(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(f("z").alias("value"))


@query("w1_erosion_then_dilation", f"WITH {P}, {R.format('min')}, e AS (SELECT a.cx, a.cy, min(b.value) AS value FROM r a JOIN r b ON b.cx BETWEEN a.cx - 2 AND a.cx + 2 AND b.cy BETWEEN a.cy - 2 AND a.cy + 2 GROUP BY 1, 2) SELECT a.cx, a.cy, max(b.value) AS value FROM e a JOIN e b ON b.cx BETWEEN a.cx - 2 AND a.cx + 2 AND b.cy BETWEEN a.cy - 2 AND a.cy + 2 GROUP BY 1, 2")
def w1(spark, sf):
    return w.stencil(w.stencil(raster(spark, sf), 2, "min"), 2, "max")


@query("w2_neighbour_features", f"WITH {P}, {R.format('max')}, o AS (SELECT unnest(range(-1, 2)) AS ox), q AS (SELECT a.cx, a.cy, greatest(0, least(a.cx + i.ox, 40)) AS nx, greatest(0, least(a.cy + j.ox, 40)) AS ny, a.value FROM r a CROSS JOIN o i CROSS JOIN o j WHERE NOT (i.ox = 0 AND j.ox = 0)) SELECT q.cx, q.cy, round(1 - (sum(r.value) - max(r.value)) / 800.0, 8) AS fc, round(abs(max(r.value) - any_value(q.value)) / any_value(q.value), 8) AS fh FROM q JOIN r ON r.cx = nx AND r.cy = ny GROUP BY q.cx, q.cy")
def w2(spark, sf):
    r = raster(spark, sf, F.max)
    n = w.neighbours(r, 1, ["value"], (0, 0, 40, 40)).groupBy("cx", "cy").agg(F.sum("n_value").alias("s"), F.max("n_value").alias("m"))
    return n.join(r, ["cx", "cy"]).select("cx", "cy", F.round(1 - (F.col("s") - F.col("m")) / 800.0, 8).alias("fc"), F.round(F.abs(F.col("m") - F.col("value")) / F.col("value"), 8).alias("fh"))


@query("w3_slope", f"WITH {P}, {R.format('min')} SELECT a.cx, a.cy, round(degrees(atan(sqrt(power((coalesce(e.value, 0) - coalesce(v.value, 0)) / 40.0, 2) + power((coalesce(n.value, 0) - coalesce(s.value, 0)) / 40.0, 2)))), 6) AS slope FROM r a LEFT JOIN r e ON e.cx = a.cx + 1 AND e.cy = a.cy LEFT JOIN r v ON v.cx = a.cx - 1 AND v.cy = a.cy LEFT JOIN r n ON n.cx = a.cx AND n.cy = a.cy + 1 LEFT JOIN r s ON s.cx = a.cx AND s.cy = a.cy - 1")
def w3(spark, sf):
    return w.slope(raster(spark, sf), 20.0).select("cx", "cy", F.round("slope", 6).alias("slope"))


@query("w4_vertical_runs", f"WITH {P}, b AS (SELECT DISTINCT CAST(floor(x / 40.0) AS BIGINT) AS cx, CAST(floor(y / 40.0) AS BIGINT) AS cy, CAST(floor(z / 4.0) AS BIGINT) AS bin FROM p), i AS (SELECT *, bin - row_number() OVER (PARTITION BY cx, cy ORDER BY bin) AS island FROM b) SELECT cx, cy, min(bin) AS first, max(bin) AS last, (max(bin) - min(bin) + 1) * 4.0 AS length FROM i GROUP BY cx, cy, island")
def w4(spark, sf):
    p = points(spark, sf).withColumn("cx", F.floor(F.col("x") / 40.0)).withColumn("cy", F.floor(F.col("y") / 40.0))
    return w.vertical_runs(p, 4.0, "cx", "cy")


LAPLACE = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
SOBEL = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
BLUR = [[1 / 16, 2 / 16, 1 / 16], [2 / 16, 4 / 16, 2 / 16], [1 / 16, 2 / 16, 1 / 16]]


def kernel_sql(k):
    rows = ", ".join(f"({x - 1}, {y - 1}, {k[y][x]!r}::DOUBLE)" for y in range(3) for x in range(3))
    return f"WITH {P}, {R.format('max')}, k AS (SELECT * FROM (VALUES {rows}) AS v(ox, oy, w)) SELECT a.cx, a.cy, round(sum(w * b.value), 6) AS value FROM r a CROSS JOIN k JOIN r b ON b.cx = a.cx + ox AND b.cy = a.cy + oy GROUP BY 1, 2"


def _kernel(k):
    return lambda spark, sf: w.kernel(raster(spark, sf, F.max), k).select("cx", "cy", F.round("value", 6).alias("value"))


for _name, _k in (("laplacian", LAPLACE), ("sobel", SOBEL), ("blur", BLUR)):
    query(f"w5_{_name}", kernel_sql(_k))(_kernel(_k))


@query("w6_tree_tops", f"WITH {E}, t AS (SELECT *, 0.02 + 0.05 * abs(z) AS radius FROM e) SELECT a.vec_id FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.vec_id <> a.vec_id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= a.radius * a.radius AND (b.z > a.z OR b.z = a.z AND b.vec_id < a.vec_id))")
def w6(spark, sf):
    return w.local_maxima(cloud(spark, sf), 0.02 + 0.05 * F.abs("z"), 0.07, "vec_id").select("vec_id")


@query("w7_tree_tops_by_circle", f"WITH {E} SELECT a.vec_id FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.vec_id <> a.vec_id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 0.05 * 0.05 AND (b.z > a.z OR b.z = a.z AND b.vec_id < a.vec_id))")
def w7(spark, sf):
    return w.local_maxima(cloud(spark, sf), F.lit(0.05), 0.05, "vec_id").select("vec_id")


@query("w8_order_along_axis", "WITH t AS (SELECT s_suppkey, s_acctbal / 100.0 AS x, CAST(s_suppkey % 37 AS DOUBLE) AS y FROM supplier) SELECT s_suppkey, row_number() OVER (ORDER BY x * 0.8 + y * 0.6, s_suppkey) AS place FROM t")
def w8(spark, sf):
    t = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey", "s_acctbal / 100.0D AS x", "CAST(s_suppkey % 37 AS DOUBLE) AS y")
    return w.numbered(t, [F.col("x") * 0.8 + F.col("y") * 0.6, F.col("s_suppkey")], "place").select("s_suppkey", "place")


TOWERS = "t AS (SELECT s_nationkey AS line, s_suppkey AS tower, s_acctbal / 100.0 AS x, CAST(s_suppkey % 37 AS DOUBLE) AS y FROM supplier)"


def towers(spark, sf):
    return spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_nationkey AS line", "s_suppkey AS tower", "s_acctbal / 100.0D AS x", "CAST(s_suppkey % 37 AS DOUBLE) AS y")


@query("w9_spans", f"WITH {TOWERS} SELECT line, tower, lead(tower) OVER w AS next, round(sqrt(power(lead(x) OVER w - x, 2) + power(lead(y) OVER w - y, 2)), 6) AS length FROM t WINDOW w AS (PARTITION BY line ORDER BY x, tower) QUALIFY next IS NOT NULL")
def w9(spark, sf):
    o = Window.partitionBy("line").orderBy("x", "tower")
    length = F.sqrt(F.pow(F.lead("x").over(o) - F.col("x"), F.lit(2)) + F.pow(F.lead("y").over(o) - F.col("y"), F.lit(2)))
    return towers(spark, sf).select("line", "tower", F.lead("tower").over(o).alias("next"), F.round(length, 6).alias("length")).where("next IS NOT NULL")


@query("w10_side_vectors", f"WITH {TOWERS}, d AS (SELECT line, tower, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM t WINDOW w AS (PARTITION BY line ORDER BY x, tower)) SELECT line, tower, round(-dy / sqrt(dx*dx + dy*dy), 6) + 0.0 AS sx, round(dx / sqrt(dx*dx + dy*dy), 6) + 0.0 AS sy FROM d WHERE dx*dx + dy*dy > 0")
def w10(spark, sf):
    o = Window.partitionBy("line").orderBy("x", "tower")
    d = lambda c: F.coalesce(F.lead(c).over(o), F.col(c)) - F.coalesce(F.lag(c).over(o), F.col(c))
    t = towers(spark, sf).withColumn("dx", d("x")).withColumn("dy", d("y")).where("dx*dx + dy*dy > 0")
    n = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return t.select("line", "tower", (F.round(-F.col("dy") / n, 6) + 0.0).alias("sx"), (F.round(F.col("dx") / n, 6) + 0.0).alias("sy"))


@query("w11_levels_of_detail", f"WITH {P}, o AS (SELECT CAST(floor(x / 125.0) AS BIGINT) AS tx, CAST(floor(y / 125.0) AS BIGINT) AS ty, row_number() OVER (PARTITION BY floor(x / 125.0), floor(y / 125.0) ORDER BY {K}) - 1 AS pos FROM p) SELECT tx, ty, CASE WHEN pos % 100 = 0 THEN 3 WHEN pos % 25 = 0 THEN 2 WHEN pos % 5 = 0 THEN 1 ELSE 0 END AS level, count(*) AS n FROM o GROUP BY ALL")
def w11(spark, sf):
    p = points(spark, sf).withColumn("tx", F.floor(F.col("x") / 125.0)).withColumn("ty", F.floor(F.col("y") / 125.0))
    place = F.row_number().over(Window.partitionBy("tx", "ty").orderBy(*KEY)) - 1
    return p.withColumn("level", w.detail_level(place)).groupBy("tx", "ty", "level").agg(F.count(F.lit(1)).alias("n"))


@query("w12_densest_slices", f"WITH {P}, s AS (SELECT CAST(floor(z / 2.0) AS BIGINT) AS slice, count(*) AS n FROM p WHERE seg_type = 3 GROUP BY 1), b AS (SELECT slice, n, max((n, -slice)) OVER (ORDER BY slice ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS best FROM s) SELECT DISTINCT -best[2] AS slice FROM b")
def w12(spark, sf):
    s = points(spark, sf).where("seg_type = 3").groupBy(F.floor(F.col("z") / 2.0).alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    return w.densest_slices(s, 5)


@query("w13_packed_boxes", f"WITH {P}, t AS (SELECT CAST(floor(x / 10.0) AS BIGINT) AS tx, count(*) AS n FROM p GROUP BY 1), r AS (SELECT tx, n, coalesce(sum(n) OVER (ORDER BY tx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM t) SELECT tx, n, CAST(floor(before * 8 / total) AS BIGINT) AS box FROM r")
def w13(spark, sf):
    t = points(spark, sf).groupBy(F.floor(F.col("x") / 10.0).alias("tx")).agg(F.count(F.lit(1)).alias("n"))
    return w.packed_boxes(t, "tx", "n", 8)
