"""Queries of spatial joins and lookups."""

from pyspark.sql import Window, functions as F

from ..operators import joins as j
from ..sources.points import E, KEY, P, cloud, points
from .filter_queries import K, RING, SIDES, HIT
from .registry import query


@query("j1_points_per_cell", f"WITH {P}, c AS (SELECT *, CAST(floor((x + 4.99999 - 0) / 10.0) AS BIGINT) AS cx, CAST(floor((y + 4.99999 - 0) / 10.0) AS BIGINT) AS cy FROM p), m AS (SELECT cx, cy, max(z) AS top FROM c GROUP BY cx, cy) SELECT {K}, cx, cy, top FROM c JOIN m USING (cx, cy) WHERE z = top")
def j1(spark, sf):
    c = j.to_cell(points(spark, sf), 10.0)
    top = c.groupBy("cx", "cy").agg(F.max("z").alias("top"))
    return c.join(top, ["cx", "cy"]).where("z = top").select(*KEY, "cx", "cy", "top")


@query("j2_radius_search", f"WITH {E} SELECT a.vec_id, count(*) AS n, round(sum((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS sum_d2 FROM e a JOIN e b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.08*0.08 GROUP BY a.vec_id")
def j2(spark, sf):
    e = cloud(spark, sf)
    return j.radius_pairs(e, e, 0.08, "vec_id", "vec_id").groupBy(F.col("a").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d2"), 6).alias("sum_d2"))


@query("j3_nearest_neighbours", f"WITH {E}, d AS (SELECT a.vec_id, b.vec_id AS other, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, other) AS rank FROM d) SELECT vec_id, round(avg(sqrt(d2)), 8) AS mean_d FROM r WHERE rank <= 6 GROUP BY vec_id")
def j3(spark, sf):
    e = cloud(spark, sf)
    return j.nearest(e, e, 6, "vec_id", "vec_id", start=0.1, skip_self=True).groupBy(F.col("a").alias("vec_id")).agg(F.round(F.avg(F.sqrt("d2")), 8).alias("mean_d"))


@query("j4_min_clearance", f"WITH {E} SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 9) AS d FROM e a CROSS JOIN e b WHERE a.label % 2 = 0 AND b.label % 2 = 1 ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), 1, 2 LIMIT 1")
def j4(spark, sf):
    e = cloud(spark, sf)
    return j.closest_pair(e.where("label % 2 = 0"), e.where("label % 2 = 1"), "vec_id", "vec_id").withColumn("d", F.round("d", 9))


THIN = "SELECT min(vec_id) AS vec_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM e WHERE label % 2 = {0} GROUP BY floor(x / 0.05), floor(y / 0.05), floor(z / 0.05)"


@query("j5_thinned_clearance", f"WITH {E}, a AS ({THIN.format(0)}), b AS ({THIN.format(1)}) SELECT round(min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))), 9) AS d FROM a CROSS JOIN b")
def j5(spark, sf):
    from ..operators.aggregates import voxel_centroids

    e = cloud(spark, sf)
    thin = lambda k: voxel_centroids(e.where(f"label % 2 = {k}"), 0.05, F.min("vec_id").alias("vec_id"))
    return j.closest_pair(thin(0), thin(1), "vec_id", "vec_id").select(F.round("d", 9).alias("d"))


@query("j6_min_horizontal_distance", f"WITH {E} SELECT round(min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))), 9) AS d FROM e a CROSS JOIN e b WHERE a.label % 2 = 0 AND b.label % 2 = 1")
def j6(spark, sf):
    e = cloud(spark, sf)
    return j.closest_pair(e.where("label % 2 = 0"), e.where("label % 2 = 1"), "vec_id", "vec_id", "xy").select(F.round("d", 9).alias("d"))


@query("j7_min_vertical_distance", f"WITH {P}, a AS (SELECT z + 3.3 AS z FROM p WHERE seg_type = 4 AND z > 40), b AS (SELECT z FROM p WHERE seg_type = 1 AND z < 60), s AS (SELECT (SELECT min(z) FROM a) AS a1, (SELECT max(z) FROM a) AS a2, (SELECT min(z) FROM b) AS b1, (SELECT max(z) FROM b) AS b2) SELECT round(CASE WHEN a1 > b2 THEN a1 - b2 WHEN a2 < b1 THEN b1 - a2 WHEN a1 BETWEEN b1 AND b2 THEN (SELECT min(abs(z - a1)) FROM b) ELSE (SELECT min(abs(z - b1)) FROM a) END, 6) AS d FROM s")
def j7(spark, sf):
    p = points(spark, sf)
    return j.min_vertical_distance(p.where("seg_type = 4 AND z > 40").select((F.col("z") + 3.3).alias("z")), p.where("seg_type = 1 AND z < 60")).select(F.round("d", 6).alias("d"))


@query("j8_points_in_spans", f"WITH {P}, b AS (SELECT * FROM (VALUES (1, 0, 0, 300, 250), (2, 300, 200, 650, 700), (3, 600, 650, 1000, 1000)) AS v(span, x1, y1, x2, y2)) SELECT span, count(*) AS n, max(z) AS top FROM p JOIN b ON x BETWEEN x1 AND x2 AND y > y1 AND y <= y2 GROUP BY span")
def j8(spark, sf):
    spans = spark.createDataFrame([(1, 0.0, 0.0, 300.0, 250.0), (2, 300.0, 200.0, 650.0, 700.0), (3, 600.0, 650.0, 1000.0, 1000.0)], "span int, x1 double, y1 double, x2 double, y2 double")
    p = points(spark, sf)
    return p.join(F.broadcast(spans), (p.x >= spans.x1) & (p.x <= spans.x2) & (p.y > spans.y1) & (p.y <= spans.y2)).groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("top"))


GROUND_RASTER = "g AS (SELECT CAST(floor((x + 2.4999975) / 5.0) AS BIGINT) AS cx, CAST(floor((y + 2.4999975) / 5.0) AS BIGINT) AS cy, min(z) AS value FROM p WHERE seg_type = 1 GROUP BY 1, 2), c AS (SELECT *, CAST(floor((x + 2.499995) / 5.0) AS BIGINT) AS cx, CAST(floor((y + 2.499995) / 5.0) AS BIGINT) AS cy FROM p)".replace("2.4999975", "2.499995")


@query("j9_height_above_ground", f"WITH {P}, {GROUND_RASTER}, n AS (SELECT DISTINCT cx, cy FROM c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.cx = c.cx AND g.cy = c.cy)), f AS (SELECT n.cx, n.cy, avg(g.value) AS value FROM n JOIN g ON g.cx BETWEEN n.cx - 2 AND n.cx + 2 AND g.cy BETWEEN n.cy - 2 AND n.cy + 2 GROUP BY 1, 2), a AS (SELECT cx, cy, value FROM g UNION ALL SELECT * FROM f) SELECT {K}, round(coalesce(greatest(0, z - value), 0), 6) AS hag FROM c LEFT JOIN a USING (cx, cy)")
def j9(spark, sf):
    p = points(spark, sf)
    raster = j.to_cell(p.where("seg_type = 1"), 5.0).groupBy("cx", "cy").agg(F.min("z").alias("value"))
    return j.hag_from_raster(p, raster, 5.0, (0.0, 0.0)).select(*KEY, F.round("hag", 6).alias("hag"))


@query("j10_height_by_lookup", f"WITH {P}, {GROUND_RASTER} SELECT {K}, coalesce(greatest(0, z - value), 0) AS hag FROM c LEFT JOIN g USING (cx, cy)")
def j10(spark, sf):
    p = points(spark, sf)
    raster = j.to_cell(p.where("seg_type = 1"), 5.0).groupBy("cx", "cy").agg(F.min("z").alias("value"))
    return j.to_cell(p, 5.0).join(raster, ["cx", "cy"], "left").select(*KEY, F.coalesce(F.greatest(F.lit(0.0), F.col("z") - F.col("value")), F.lit(0.0)).alias("hag"))


@query("j11_nearest_ground", f"WITH {E}, q AS (SELECT * FROM e WHERE label % 3 = 0), o AS (SELECT * FROM e WHERE label % 3 = 1), d AS (SELECT q.vec_id, o.vec_id AS g, (q.x-o.x)*(q.x-o.x)+(q.y-o.y)*(q.y-o.y) AS d2 FROM q JOIN o ON (q.x-o.x)*(q.x-o.x)+(q.y-o.y)*(q.y-o.y) <= 0.03*0.03), m AS (SELECT vec_id, arg_min(g, d2) AS ground_id, round(sqrt(min(d2)), 9) AS d_xy FROM d GROUP BY vec_id) SELECT q.vec_id, coalesce(ground_id, -1) AS ground_id, coalesce(d_xy, -1) AS d_xy FROM q LEFT JOIN m USING (vec_id)")
def j11(spark, sf):
    e = cloud(spark, sf)
    out = j.nearest_ground(e.where("label % 3 = 0"), e.where("label % 3 = 1"), "vec_id", "vec_id", 0.03)
    return out.select("vec_id", F.coalesce("ground_id", F.lit(-1)).alias("ground_id"), F.coalesce(F.round("d_xy", 9), F.lit(-1.0)).alias("d_xy"))


CURVES = "u AS (SELECT * FROM (VALUES (1, 100.0, 0.0001, -0.1, 60.0), (2, 104.0, 0.0001, -0.1, 58.0), (3, 300.0, 0.0002, -0.2, 80.0)) AS v(curve, x0, ca, cb, cc)), h AS (SELECT {K}, curve, x, y, z, sqrt((x - x0) * (x - x0) + (z - (ca * y * y + cb * y + cc)) * (z - (ca * y * y + cb * y + cc))) AS d FROM p CROSS JOIN u)"


@query("j12_points_near_curve_pairs", f"WITH {P}, {CURVES.format(K=K)} SELECT a.curve AS i, b.curve AS j, count(*) AS n, round(avg(a.x), 6) AS x, round(avg(a.y), 6) AS y, round(avg(a.z), 6) AS z FROM h a JOIN h b USING ({K}) WHERE a.curve < b.curve AND a.d <= 12 AND b.d <= 12 GROUP BY 1, 2")
def j12(spark, sf):
    rows = [(1, 100.0, 0.0001, -0.1, 60.0), (2, 104.0, 0.0001, -0.1, 58.0), (3, 300.0, 0.0002, -0.2, 80.0)]
    curves = F.array(*[F.struct(F.lit(k).alias("curve"), *[F.lit(v).alias(n) for n, v in zip(("x0", "a", "b", "c"), r)]) for k, *r in rows])
    away = lambda u: F.sqrt((F.col("x") - u["x0"]) * (F.col("x") - u["x0"]) + (F.col("z") - (u["a"] * F.col("y") * F.col("y") + u["b"] * F.col("y") + u["c"])) * (F.col("z") - (u["a"] * F.col("y") * F.col("y") + u["b"] * F.col("y") + u["c"])))
    near = points(spark, sf).withColumn("near", F.transform(F.filter(curves, lambda u: away(u) <= 12), lambda u: u["curve"])).where(F.size("near") > 1)
    pairs = near.withColumn("i", F.explode("near")).withColumn("j", F.explode("near")).where("i < j")
    return pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in "xyz"])


@query("j13_roads_meeting_cloud", f"WITH {P}, b AS (SELECT min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM p WHERE seg_type = 1 AND y < 500), r AS (SELECT o_custkey AS road, min(o_totalprice / 100.0) AS rx1, min(CAST(o_orderkey % 1500 AS DOUBLE)) AS ry1, max(o_totalprice / 100.0) AS rx2, max(CAST(o_orderkey % 1500 AS DOUBLE)) AS ry2 FROM orders GROUP BY o_custkey) SELECT road FROM r, b WHERE rx1 <= x2 AND x1 <= rx2 AND ry1 <= y2 AND y1 <= ry2")
def j13(spark, sf):
    box = points(spark, sf).where("seg_type = 1 AND y < 500").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    at = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey AS road", "o_totalprice / 100.0D AS x", "CAST(o_orderkey % 1500 AS DOUBLE) AS y")
    roads = at.groupBy("road").agg(F.min("x").alias("rx1"), F.min("y").alias("ry1"), F.max("x").alias("rx2"), F.max("y").alias("ry2"))
    return roads.join(F.broadcast(box), F.expr("rx1 <= x2 AND x1 <= rx2 AND ry1 <= y2 AND y1 <= ry2")).select("road")


TILE_OF = "t AS (SELECT DISTINCT cluster_id, CAST(floor(x / 250.0) AS VARCHAR) || '_' || CAST(floor(y / 250.0) AS VARCHAR) AS tile FROM p)"


@query("j14_clusters_of_tiles", f"WITH {P}, t AS (SELECT DISTINCT cluster_id, CAST(floor(x / 250.0) AS BIGINT) AS tx, CAST(floor(y / 250.0) AS BIGINT) AS ty FROM p) SELECT tx, ty, count(*) AS n_clusters, min(cluster_id) AS first FROM t GROUP BY tx, ty")
def j14(spark, sf):
    own = points(spark, sf).select("cluster_id", F.floor(F.col("x") / 250.0).alias("tx"), F.floor(F.col("y") / 250.0).alias("ty")).distinct()
    clusters = own.groupBy("cluster_id").agg(F.collect_set(F.struct("tx", "ty")).alias("tile_ids"))  # the registry's form: tiles as an array
    member = clusters.select("cluster_id", F.explode("tile_ids").alias("t")).select("cluster_id", "t.*")
    return own.select("tx", "ty").distinct().join(member, ["tx", "ty"]).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n_clusters"), F.min("cluster_id").alias("first"))


@query("j15_registered_clusters", f"WITH {P} SELECT {K} FROM p WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = cluster_id AND s_acctbal > 0)")
def j15(spark, sf):
    live = spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal > 0").selectExpr("CAST(s_suppkey AS INT) AS cluster_id")
    return points(spark, sf).join(live, "cluster_id", "left_semi").select(*KEY)


@query("j16_unregistered_clusters", f"WITH {P} SELECT {K} FROM p WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = cluster_id AND s_acctbal > 0)")
def j16(spark, sf):
    live = spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal > 0").selectExpr("CAST(s_suppkey AS INT) AS cluster_id")
    return points(spark, sf).join(live, "cluster_id", "left_anti").select(*KEY)


@query("j17_class_bridge", f"WITH {P}, m AS (SELECT * FROM (VALUES (1, 11), (2, 12), (6, 16)) AS v(f, t)) SELECT {K}, coalesce(t, seg_type) AS seg_type FROM p LEFT JOIN m ON f = seg_type")
def j17(spark, sf):
    return j.remapped(points(spark, sf), {1: 11, 2: 12, 6: 16}).select(*KEY, "seg_type")


@query("j18_capsule_search", f"WITH {P}, t AS (SELECT *, greatest(0, least(1, ((x - 100) * 600.0 + (y - 50) * 700.0 + (z - 20) * 40.0) / (600.0 * 600 + 700.0 * 700 + 40.0 * 40))) AS t FROM p) SELECT {K} FROM t WHERE (x - (100 + t * 600)) * (x - (100 + t * 600)) + (y - (50 + t * 700)) * (y - (50 + t * 700)) + (z - (20 + t * 40)) * (z - (20 + t * 40)) <= 900")
def j18(spark, sf):
    return j.segment_search(points(spark, sf), (100.0, 50.0, 20.0), (700.0, 750.0, 60.0), 30.0).select(*KEY)


@query("j19_model_library_match", f"WITH {P}, d AS (SELECT cluster_id, max(x) - min(x) AS dx, max(y) - min(y) AS dy, max(z) - min(z) AS dz FROM p GROUP BY cluster_id), m AS (SELECT * FROM (VALUES (1, 900.0, 900.0, 98.0), (2, 800.0, 950.0, 96.0), (3, 950.0, 990.0, 98.0)) AS v(model, mx, my, mz)), r AS (SELECT cluster_id, model, (dx-mx)*(dx-mx)+(dy-my)*(dy-my)+(dz-mz)*(dz-mz) AS rms FROM d CROSS JOIN m WHERE abs(dx-mx) < 300 AND abs(dy-my) < 300 AND abs(dz-mz) < 20) SELECT cluster_id, arg_min(model, (rms, model)) AS model, round(min(rms), 4) AS rms FROM r GROUP BY cluster_id")
def j19(spark, sf):
    boxes = points(spark, sf).groupBy("cluster_id").agg(*[(F.max(c) - F.min(c)).alias(f"d{c}") for c in "xyz"])
    models = spark.createDataFrame([(1, 900.0, 900.0, 98.0), (2, 800.0, 950.0, 96.0), (3, 950.0, 990.0, 98.0)], "model int, mx double, my double, mz double")
    near = boxes.join(F.broadcast(models), (F.abs(F.col("dx") - F.col("mx")) < 300) & (F.abs(F.col("dy") - F.col("my")) < 300) & (F.abs(F.col("dz") - F.col("mz")) < 20))
    rms = sum(((F.col(f"d{c}") - F.col(f"m{c}")) * (F.col(f"d{c}") - F.col(f"m{c}")) for c in "xyz"), F.lit(0.0))
    return near.withColumn("rms", rms).groupBy("cluster_id").agg(F.min_by("model", F.struct("rms", "model")).alias("model"), F.round(F.min("rms"), 4).alias("rms"))
