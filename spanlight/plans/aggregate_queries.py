"""Queries of aggregates, sampling, ordering and set operations."""

from pyspark.sql import Window, functions as F

from ..functions import geometry as g
from ..operators import aggregates as a, filters as f, sampling as s
from ..sources.points import E, KEY, P, cloud, points
from .filter_queries import HIT, INSIDE, K, RING, SIDES
from .registry import query


def N():
    return F.count(F.lit(1)).alias("n")

BOX = ", ".join(f"{w}({c}) AS {w}_{c}" for w in ("min", "max") for c in "xyz")


@query("a1_bounds", f"WITH {P} SELECT {BOX} FROM p")
def a1(spark, sf):
    return a.bounds(points(spark, sf))


@query("a2_bounds_by_cluster", f"WITH {P} SELECT cluster_id, {BOX} FROM p GROUP BY cluster_id")
def a2(spark, sf):
    return a.bounds(points(spark, sf), "cluster_id")


@query("a3_voxel_centroids", f"WITH {P} SELECT CAST(floor(x/10.0) AS BIGINT) AS vx, CAST(floor(y/10.0) AS BIGINT) AS vy, CAST(floor(z/10.0) AS BIGINT) AS vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM p GROUP BY 1, 2, 3")
def a3(spark, sf):
    return a.voxel_centroids(points(spark, sf), 10.0).select("vx", "vy", "vz", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("a4_grid_cells", f"WITH {P} SELECT CAST(greatest(0, least(floor((x - 50) / 20.0), 39)) AS BIGINT) AS cx, CAST(greatest(0, least(floor((y - 50) / 20.0), 39)) AS BIGINT) AS cy, count(*) AS n FROM p GROUP BY 1, 2")
def a4(spark, sf):
    return points(spark, sf).groupBy(a.clamped_cell(F.col("x"), F.lit(50.0), 20.0, 40).alias("cx"), a.clamped_cell(F.col("y"), F.lit(50.0), 20.0, 40).alias("cy")).agg(N())


@query("a5_voxel_labels", f"WITH {P} SELECT CAST(floor(x/25.0) AS BIGINT) AS vx, CAST(floor(y/25.0) AS BIGINT) AS vy, CAST(floor(z/25.0) AS BIGINT) AS vz, count(*) AS n, max(seg_type) AS label FROM p GROUP BY 1, 2, 3")
def a5(spark, sf):
    return points(spark, sf).groupBy(*a.voxel(25.0)).agg(N(), F.max("seg_type").alias("label"))


ROBUST = "m AS (SELECT seg_type, min(x) AS s FROM p GROUP BY seg_type), b AS (SELECT p.seg_type, floor((x - s) / 20.0) AS bin, count(*) AS n, min(x) AS lo, max(x) AS hi FROM p JOIN m USING (seg_type) GROUP BY 1, 2 HAVING count(*) > 20)"


@query("a6_robust_extremes", f"WITH {P}, {ROBUST} SELECT seg_type, arg_min(lo, bin) AS low, arg_max(hi, bin) AS high FROM b GROUP BY seg_type HAVING min(bin) < max(bin)")
def a6(spark, sf):
    return a.robust_extremes(points(spark, sf), "x", 20.0, 20, "seg_type")


@query("a7_vertical_layers", f"WITH {P} SELECT CAST(floor(z / 5.0) AS BIGINT) AS layer, count(*) AS n FROM p GROUP BY 1")
def a7(spark, sf):
    return a.slices(points(spark, sf), 5.0).groupBy("layer").agg(N())


@query("a8_dense_layers", f"WITH {P}, l AS (SELECT CASE WHEN z >= 80 THEN -1 ELSE CAST(floor((z - 10) / 7.0) AS BIGINT) END AS layer FROM p WHERE z >= 10), d AS (SELECT layer, count(*) AS n FROM l GROUP BY layer) SELECT layer, n, dense_rank() OVER (ORDER BY layer) AS rank FROM d")
def a8(spark, sf):
    layers = a.slices(points(spark, sf), 7.0, 10.0, 80.0).groupBy("layer").agg(N())
    return layers.withColumn("rank", F.dense_rank().over(Window.orderBy("layer")))


@query("a9_slices_by_cluster", f"WITH {P} SELECT cluster_id, CAST(floor((z * 0.5 + 3) / 4.0) AS BIGINT) AS slice, count(*) AS n FROM p GROUP BY 1, 2")
def a9(spark, sf):
    return points(spark, sf).withColumn("z", F.col("z") * 0.5 + 3).groupBy("cluster_id", F.floor(F.col("z") / 4.0).alias("slice")).agg(N())


@query("a10_binary_mask", f"WITH {P} SELECT DISTINCT CAST(floor(x / 4.0) AS BIGINT) AS cx, CAST(floor(y / 4.0) AS BIGINT) AS cy FROM p WHERE seg_type = 2")
def a10(spark, sf):
    return points(spark, sf).where("seg_type = 2").select(F.floor(F.col("x") / 4.0).alias("cx"), F.floor(F.col("y") / 4.0).alias("cy")).distinct()


@query("a11_height_raster", f"WITH {P} SELECT CAST(floor(x / 8.0) AS BIGINT) AS cx, CAST(floor(y / 8.0) AS BIGINT) AS cy, max(z) AS value FROM p GROUP BY 1, 2")
def a11(spark, sf):
    return points(spark, sf).groupBy(F.floor(F.col("x") / 8.0).alias("cx"), F.floor(F.col("y") / 8.0).alias("cy")).agg(F.max("z").alias("value"))


@query("a12_ground_raster", f"WITH {P} SELECT CAST(floor(x / 8.0) AS BIGINT) AS cx, CAST(floor(y / 8.0) AS BIGINT) AS cy, min(z) AS value FROM p WHERE seg_type = 1 GROUP BY 1, 2")
def a12(spark, sf):
    return points(spark, sf).where("seg_type = 1").groupBy(F.floor(F.col("x") / 8.0).alias("cx"), F.floor(F.col("y") / 8.0).alias("cy")).agg(F.min("z").alias("value"))


TOPS = "SELECT CAST(floor(x / {0}) AS BIGINT) AS cx, CAST(floor(y / {0}) AS BIGINT) AS cy, {1}, z, row_number() OVER (PARTITION BY floor(x / {0}), floor(y / {0}) ORDER BY z DESC, {1}) AS rank FROM p WHERE {2}"


@query("a13_canopy_tops", f"WITH {P}, t AS ({TOPS.format('12.0', K, 'seg_type IN (2, 15)')}) SELECT cx, cy, {K}, z FROM t WHERE rank = 1")
def a13(spark, sf):
    return s.cell_tops(points(spark, sf).where("seg_type IN (2, 15)"), 12.0, KEY)


@query("a14_building_surface", f"WITH {P}, t AS ({TOPS.format('6.0', K, 'seg_type = 6')}) SELECT cx, cy, {K}, z FROM t WHERE rank = 1")
def a14(spark, sf):
    return s.cell_tops(points(spark, sf).where("seg_type = 6"), 6.0, KEY)


@query("a15_statistics", f"WITH {P} SELECT seg_type, round(avg(x), 6) AS mean, round(var_samp(x), 4) AS variance, round(stddev_samp(x), 6) AS sd, round(median(x), 6) AS median FROM p GROUP BY seg_type")
def a15(spark, sf):
    return points(spark, sf).groupBy("seg_type").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.var_samp("x"), 4).alias("variance"), F.round(F.stddev_samp("x"), 6).alias("sd"), F.round(F.median("x"), 6).alias("median"))


BINS = "b AS (SELECT DISTINCT CAST(floor(x / 15.0) AS BIGINT) AS cx, CAST(floor(y / 15.0) AS BIGINT) AS cy, CAST(floor(z / 2.0) AS BIGINT) AS bin FROM p), i AS (SELECT *, bin - row_number() OVER (PARTITION BY cx, cy ORDER BY bin) AS island FROM b), r AS (SELECT cx, cy, island, (max(bin) - min(bin) + 1) * 2.0 AS length FROM i GROUP BY 1, 2, 3)"


@query("a16_cell_features", f"WITH {P}, {BINS}, f AS (SELECT cx, cy, sum(length) AS runs FROM r GROUP BY 1, 2), c AS (SELECT CAST(floor(x / 15.0) AS BIGINT) AS cx, CAST(floor(y / 15.0) AS BIGINT) AS cy, max(z) AS h, count(*) FILTER (z > 15) AS fn FROM p GROUP BY 1, 2) SELECT cx, cy, h, fn, round(runs / h, 8) AS fv FROM c JOIN f USING (cx, cy)")
def a16(spark, sf):
    from ..operators.windows import vertical_runs

    p = points(spark, sf).withColumn("cx", F.floor(F.col("x") / 15.0)).withColumn("cy", F.floor(F.col("y") / 15.0))
    runs = vertical_runs(p, 2.0, "cx", "cy").groupBy("cx", "cy").agg(F.sum("length").alias("runs"))
    cells = p.groupBy("cx", "cy").agg(F.max("z").alias("h"), F.count_if(F.col("z") > 15).alias("fn"))
    return cells.join(runs, ["cx", "cy"]).select("cx", "cy", "h", "fn", F.round(F.col("runs") / F.col("h"), 8).alias("fv"))


@query("a17_vegetation_classes", f"WITH {P} SELECT {K}, CASE WHEN z < 10 THEN 3 WHEN z < 40 THEN 4 ELSE 15 END AS label FROM p WHERE seg_type = 2")
def a17(spark, sf):
    return points(spark, sf).where("seg_type = 2").select(*KEY, F.when(F.col("z") < 10, 3).when(F.col("z") < 40, 4).otherwise(15).alias("label"))


@query("a18_points_by_type", f"WITH {P} SELECT seg_type, count(*) AS n, count(DISTINCT cluster_id) AS clusters FROM p WHERE seg_type IN (1, 2, 6) GROUP BY seg_type")
def a18(spark, sf):
    return points(spark, sf).where(F.col("seg_type").isin(1, 2, 6)).groupBy("seg_type").agg(N(), F.count_distinct("cluster_id").alias("clusters"))


@query("a19_box_counts", f"WITH {P} SELECT CAST(floor(x / 100.0) AS BIGINT) AS bx, CAST(floor(y / 100.0) AS BIGINT) AS by_, count(*) AS n FROM p WHERE x BETWEEN 100 AND 700 AND y BETWEEN 100 AND 700 GROUP BY 1, 2")
def a19(spark, sf):
    return points(spark, sf).where(g.in_box(F.col("x"), F.col("y"), (100, 100, 700, 700))).groupBy(F.floor(F.col("x") / 100.0).alias("bx"), F.floor(F.col("y") / 100.0).alias("by_")).agg(N())


@query("a20_density", f"WITH {P}, {SIDES}, d AS (SELECT z FROM p WHERE {INSIDE}) SELECT count(*) AS n, round(count(*) / {g.ring_area(RING)!r}, 10) AS density, max(z) - min(z) AS dz FROM d")
def a20(spark, sf):
    return a.density(points(spark, sf).where(f.spatial("polygon", RING)), g.ring_area(RING)).select("n", F.round("density", 10).alias("density"), "dz")


@query("a21_cluster_area", f"WITH {P} SELECT cluster_id, count(DISTINCT (floor(x / 5.0), floor(y / 5.0))) * 25.0 AS area FROM p GROUP BY cluster_id")
def a21(spark, sf):
    return a.occupied_area(points(spark, sf), 5.0, "cluster_id")


@query("a22_tree_by_coefficients", f"WITH {P}, b AS (SELECT cluster_id, max(z) - min(z) AS h, max(z) AS top, greatest(max(x) - min(x), max(y) - min(y)) AS w, count(*) AS n FROM p GROUP BY cluster_id), u AS (SELECT cluster_id, count(*) AS upper FROM p JOIN b USING (cluster_id) WHERE z > top - 0.3 * h GROUP BY cluster_id) SELECT cluster_id, CASE WHEN w > 9.5 * h THEN h WHEN upper > 0.35 * n THEN round(sqrt(w * w + h * h), 6) ELSE w END AS length FROM b LEFT JOIN u USING (cluster_id)")
def a22(spark, sf):
    p = points(spark, sf)
    b = p.groupBy("cluster_id").agg((F.max("z") - F.min("z")).alias("h"), F.max("z").alias("top"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("w"), N())
    u = p.join(b, "cluster_id").where("z > top - 0.3D * h").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("upper"))
    return b.join(u, "cluster_id", "left").select("cluster_id", F.expr("CASE WHEN w > 9.5D * h THEN h WHEN upper > 0.35D * n THEN round(sqrt(w * w + h * h), 6) ELSE w END").alias("length"))


@query("a23_tree_metrics", f"WITH {P} SELECT cluster_id, max(z) AS top_z, max(z - 2) AS height, round(sqrt((max(x)-min(x))*(max(x)-min(x)) + (max(y)-min(y))*(max(y)-min(y))), 6) AS crown_size, count(DISTINCT (floor(x / 0.5), floor(y / 0.5))) * 0.25 AS crown_area FROM p WHERE seg_type = 2 GROUP BY cluster_id")
def a23(spark, sf):
    t = a.tree_metrics(points(spark, sf).where("seg_type = 2").withColumn("hag", F.col("z") - 2), "cluster_id")
    return t.withColumn("crown_size", F.round("crown_size", 6))


@query("a24_fill_rate", f"WITH {P}, b AS (SELECT seg_type, min(z) AS lo, max(z) AS hi FROM p GROUP BY seg_type) SELECT seg_type, round(count(DISTINCT floor((z - lo) / 1.5)) / (floor((any_value(hi) - any_value(lo)) / 1.5) + 1), 8) AS fill FROM p JOIN b USING (seg_type) GROUP BY seg_type")
def a24(spark, sf):
    return a.fill_rate(points(spark, sf), "z", 1.5, "seg_type").select("seg_type", F.round("fill", 8).alias("fill"))


@query("a25_column_features", f"WITH {P} SELECT CAST(floor(x / 30.0) AS BIGINT) AS cx, CAST(floor(y / 30.0) AS BIGINT) AS cy, max(x) - min(x) AS x_len, max(y) - min(y) AS y_len, count(DISTINCT (floor(x / 3.0), floor(y / 3.0))) / 100.0 AS xy_fill, bool_or(seg_type = 3) AS has_tower, bool_or(seg_type = 4) AS has_wire FROM p GROUP BY 1, 2")
def a25(spark, sf):
    return points(spark, sf).groupBy(F.floor(F.col("x") / 30.0).alias("cx"), F.floor(F.col("y") / 30.0).alias("cy")).agg((F.max("x") - F.min("x")).alias("x_len"), (F.max("y") - F.min("y")).alias("y_len"), (F.count_distinct(F.floor(F.col("x") / 3.0), F.floor(F.col("y") / 3.0)) / 100.0).alias("xy_fill"), F.bool_or(F.col("seg_type") == 3).alias("has_tower"), F.bool_or(F.col("seg_type") == 4).alias("has_wire"))


AXIS = "m AS (SELECT seg_type, avg(x) AS mx, avg(y) AS my, cos(atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)) / 2) AS ux, sin(atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)) / 2) AS uy FROM p GROUP BY seg_type)"


@query("a26_main_axis_extent", f"WITH {P}, {AXIS}, o AS (SELECT p.seg_type, (x - mx) * ux + (y - my) * uy AS t FROM p JOIN m USING (seg_type)) SELECT seg_type, round((max(t) - min(t) + 2) / 2, 4) AS radius FROM o GROUP BY seg_type")
def a26(spark, sf):
    p = points(spark, sf)
    t = p.join(a.plane_axis(p, "seg_type"), "seg_type").withColumn("t", (F.col("x") - F.col("mx")) * F.col("ux") + (F.col("y") - F.col("my")) * F.col("uy"))
    return t.groupBy("seg_type").agg(F.round((F.max("t") - F.min("t") + 2) / 2, 4).alias("radius"))


@query("a27_eigenvalues", f"WITH {P}, c AS (SELECT cluster_id, var_pop(x) + var_pop(y) + var_pop(z) AS trace, var_pop(x) * var_pop(y) + var_pop(x) * var_pop(z) + var_pop(y) * var_pop(z) - covar_pop(x, y)**2 - covar_pop(x, z)**2 - covar_pop(y, z)**2 AS minors FROM p GROUP BY cluster_id) SELECT cluster_id, round(trace, 2) AS trace, round(minors, 0) AS minors, true AS ordered FROM c")
def a27(spark, sf):
    e = a.eigenvalues(a.covariance(points(spark, sf), "cluster_id"))
    l1, l2, l3 = F.col("l1"), F.col("l2"), F.col("l3")
    return e.select("cluster_id", F.round(l1 + l2 + l3, 2).alias("trace"), F.round(l1 * l2 + l1 * l3 + l2 * l3, 0).alias("minors"), ((l1 >= l2 - 1e-9) & (l2 >= l3 - 1e-9) & (l3 >= -1e-6)).alias("ordered"))


@query("a28_shape_features", f"""WITH {P}, v AS (SELECT cluster_id, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM p GROUP BY cluster_id), q AS (SELECT *, (a + b + c) / 3 AS q FROM v),
 s AS (SELECT *, sqrt(((a - q)**2 + (b - q)**2 + (c - q)**2 + 2 * (d * d + e * e + f * f)) / 6) AS s FROM q), t AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / s**3 / 2))) / 3 AS t FROM s WHERE s > 0),
 l AS (SELECT cluster_id, q + 2 * s * cos(t) AS l1, q + 2 * s * cos(t - 2 * pi() / 3) AS l2, q + 2 * s * cos(t + 2 * pi() / 3) AS l3 FROM t) SELECT cluster_id, round((l1 - l2) / l1, 6) AS linearity, round(l3 / l1, 6) AS sphericity FROM l""")
def a28(spark, sf):
    return a.shape_features(a.eigenvalues(a.covariance(points(spark, sf), "cluster_id"))).select("cluster_id", F.round("linearity", 6).alias("linearity"), F.round("sphericity", 6).alias("sphericity"))


#: Least-squares parabolas z = a y² + b y + c of the groups {0} of {1}, by Cramer's rule on raw moments about the groups' means: fit({0}, n, a, b, c).
PARABOLA = """mu AS (SELECT {0}, avg(y) AS m FROM {1} GROUP BY {0}), mo AS (SELECT {0}, any_value(m) AS m, count(*) AS n, sum(y - m) AS s1, sum((y - m)**2) AS s2, sum((y - m)**3) AS s3, sum((y - m)**4) AS s4, sum(z) AS q0, sum((y - m) * z) AS q1, sum((y - m)**2 * z) AS q2
 FROM (SELECT * FROM {1}) JOIN mu USING ({0}) GROUP BY {0}), de AS (SELECT *, nullif(s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2), 0) AS d FROM mo),
 fa AS (SELECT *, (q2 * (s2 * n - s1 * s1) - s3 * (q1 * n - s1 * q0) + s2 * (q1 * s1 - s2 * q0)) / d AS ta, (s4 * (q1 * n - s1 * q0) - q2 * (s3 * n - s1 * s2) + s2 * (s3 * q0 - q1 * s2)) / d AS tb, (s4 * (s2 * q0 - q1 * s1) - s3 * (s3 * q0 - q1 * s2) + q2 * (s3 * s1 - s2 * s2)) / d AS tc FROM de),
 fit AS (SELECT {0}, n, ta AS a, tb - 2 * ta * m AS b, ta * m * m - tb * m + tc AS c FROM fa)"""


@query("a29_parabola_fit", f"WITH {P}, {PARABOLA.format('seg_type', 'p')} SELECT seg_type, n, round(a * 1e6, 4) AS a, round(b * 1e3, 5) AS b, round(c, 6) AS c FROM fit WHERE a IS NOT NULL")
def a29(spark, sf):
    return a.parabola_fit(points(spark, sf), "seg_type").where("a is not null").select("seg_type", "n", F.round(F.col("a") * 1e6, 4).alias("a"), F.round(F.col("b") * 1e3, 5).alias("b"), F.round("c", 6).alias("c"))


@query("a29_robust_curve_fit")
def a29_robust(spark, sf):
    p = points(spark, sf).where("seg_type = 4")
    return a.robust_parabola(p, "cluster_id").select("cluster_id", "n", *[F.round(c, 6).alias(c) for c in "abc"])


@query("a34_polygon_area", "WITH o AS (SELECT o_custkey, o_totalprice / 100 AS x, CAST(o_orderkey % 997 AS DOUBLE) AS y FROM orders), r AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY x, y)) SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2, 4) AS area FROM r GROUP BY o_custkey HAVING count(*) >= 3")
def a34(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    ring = F.array_sort(F.collect_list(F.struct((F.col("o_totalprice") / 100).alias("x"), (F.col("o_orderkey") % 997).cast("double").alias("y"))))
    rings = o.groupBy("o_custkey").agg(ring.alias("ring")).where(F.size("ring") >= 3)
    return rings.select("o_custkey", F.size("ring").cast("long").alias("n"), F.round(g.polygon_area(F.col("ring")), 4).alias("area"))


@query("a35_box_area", f"WITH {P} SELECT cluster_id, (max(x) - min(x)) * (max(y) - min(y)) AS xy, (max(x) - min(x)) * (max(z) - min(z)) AS xz FROM p GROUP BY cluster_id")
def a35(spark, sf):
    dx, dy, dz = (F.max(c) - F.min(c) for c in "xyz")
    b = points(spark, sf).groupBy("cluster_id").agg(dx.alias("dx"), dy.alias("dy"), dz.alias("dz"))
    return b.select("cluster_id", g.box_area(F.col("dx"), F.col("dy")).alias("xy"), g.box_area(F.col("dx"), F.col("dz")).alias("xz"))


TRI = "t AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS ax, CAST(embedding[2] AS DOUBLE) AS ay, CAST(embedding[3] AS DOUBLE) AS az, CAST(embedding[4] AS DOUBLE) AS bx, CAST(embedding[5] AS DOUBLE) AS by_, CAST(embedding[6] AS DOUBLE) AS bz FROM embeddings)"


@query("a36_mesh_area", f"WITH {TRI} SELECT round(sum(sqrt((ay*bz-az*by_)**2 + (az*bx-ax*bz)**2 + (ax*by_-ay*bx)**2) / 2), 6) AS area FROM t")
def a36(spark, sf):
    v = [F.col("embedding")[i].cast("double") for i in range(6)]
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.agg(F.round(F.sum(s.triangle_area([F.lit(0.0)] * 3, v[:3], v[3:])), 6).alias("area"))


@query("a37_registration_error", f"WITH {E}, q AS (SELECT vec_id, x + 0.01 AS x, y - 0.02 AS y, z FROM e WHERE label % 2 = 0), o AS (SELECT * FROM e WHERE label % 2 = 1), d AS (SELECT q.vec_id, min((q.x-o.x)**2 + (q.y-o.y)**2 + (q.z-o.z)**2) AS d2 FROM q CROSS JOIN o GROUP BY q.vec_id) SELECT round(avg(d2), 8) AS rms FROM d")
def a37(spark, sf):
    from ..operators.joins import nearest

    e = cloud(spark, sf)
    q = e.where("label % 2 = 0").withColumn("x", F.col("x") + 0.01).withColumn("y", F.col("y") - 0.02)
    return nearest(q, e.where("label % 2 = 1"), 1, "vec_id", "vec_id", start=0.1).agg(F.round(F.avg("d2"), 8).alias("rms"))


@query("a38_clusters_in_circle", f"WITH {P} SELECT cluster_id, count(*) AS n FROM p WHERE (x - 400)**2 + (y - 400)**2 <= 22500 AND seg_type IN (2, 6) GROUP BY cluster_id")
def a38(spark, sf):
    return points(spark, sf).where(f.spatial("circle", (400.0, 400.0, 150.0)) & F.col("seg_type").isin(2, 6)).groupBy("cluster_id").agg(N())


@query("a39_clusters_by_polygon", f"WITH {P}, {SIDES}, i AS (SELECT cluster_id, {INSIDE} AS inside FROM p) SELECT cluster_id, CASE WHEN bool_and(inside) THEN 'inside' ELSE 'cut' END AS kind FROM i GROUP BY cluster_id HAVING bool_or(inside)")
def a39(spark, sf):
    i = points(spark, sf).withColumn("inside", f.spatial("polygon", RING))
    return i.groupBy("cluster_id").agg(F.bool_and("inside").alias("every"), F.bool_or("inside").alias("some")).where("some").select("cluster_id", F.when(F.col("every"), "inside").otherwise("cut").alias("kind"))


@query("a40_outlier_cells", f"WITH {P}, c AS (SELECT CAST(floor(x / 20.0) AS BIGINT) AS cx, CAST(floor(y / 20.0) AS BIGINT) AS cy, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT avg(n) AS m, stddev_samp(n) AS sd FROM c) SELECT cx, cy, n FROM c, s WHERE n - m > 2 * sd")
def a40(spark, sf):
    c = points(spark, sf).groupBy(F.floor(F.col("x") / 20.0).alias("cx"), F.floor(F.col("y") / 20.0).alias("cy")).agg(N())
    stats = c.agg(F.avg("n").alias("m"), F.stddev_samp("n").alias("sd"))
    return c.join(F.broadcast(stats), F.col("n") - F.col("m") > 2 * F.col("sd")).select("cx", "cy", "n")


@query("t1_by_height", f"WITH {P} SELECT {K}, z FROM p ORDER BY z DESC, {K} LIMIT 500")
def t1(spark, sf):
    return points(spark, sf).orderBy(F.desc("z"), *KEY).limit(500).select(*KEY, "z")


@query("t2_by_distance", f"WITH {P} SELECT {K}, round(sqrt((x-300)**2 + (y-300)**2), 6) AS d FROM p ORDER BY (x-300)*(x-300) + (y-300)*(y-300), {K} LIMIT 200")
def t2(spark, sf):
    d2 = (F.col("x") - 300) * (F.col("x") - 300) + (F.col("y") - 300) * (F.col("y") - 300)
    return points(spark, sf).orderBy(d2, *KEY).limit(200).select(*KEY, F.round(F.sqrt(d2), 6).alias("d"))


@query("t4_largest_clusters", f"WITH {P}, c AS (SELECT seg_type, cluster_id, count(*) AS n FROM p GROUP BY 1, 2) SELECT seg_type, cluster_id, n FROM c QUALIFY row_number() OVER (PARTITION BY seg_type ORDER BY n DESC, cluster_id) = 1")
def t4(spark, sf):
    c = points(spark, sf).groupBy("seg_type", "cluster_id").agg(N())
    return c.groupBy("seg_type").agg(F.max_by("cluster_id", F.struct("n", -F.col("cluster_id"))).alias("cluster_id"), F.max("n").alias("n"))


@query("t5_main_trunk", f"WITH {P}, l AS (SELECT DISTINCT cluster_id, floor(z / 5.0) AS layer FROM p), c AS (SELECT cluster_id, CAST(max(layer) - min(layer) AS BIGINT) AS span, count(*) AS layers FROM l GROUP BY cluster_id) SELECT cluster_id, span, layers FROM c ORDER BY span DESC, layers DESC, cluster_id LIMIT 1")
def t5(spark, sf):
    return a.slices(points(spark, sf), 5.0).groupBy("cluster_id").agg((F.max("layer") - F.min("layer")).alias("span"), F.count_distinct("layer").alias("layers")).orderBy(F.desc("span"), F.desc("layers"), "cluster_id").limit(1)


@query("t6_extreme_points", f"WITH {P} SELECT seg_type, arg_min(y, (x, y)) AS left_y, arg_max(y, (x, y)) AS right_y, arg_min(x, (y, x)) AS bottom_x, arg_max(x, (y, x)) AS top_x FROM p GROUP BY seg_type")
def t6(spark, sf):
    return points(spark, sf).groupBy("seg_type").agg(F.min_by("y", F.struct("x", "y")).alias("left_y"), F.max_by("y", F.struct("x", "y")).alias("right_y"), F.min_by("x", F.struct("y", "x")).alias("bottom_x"), F.max_by("x", F.struct("y", "x")).alias("top_x"))


@query("t7_random_sample", f"WITH {P} SELECT {K} FROM p ORDER BY md5('7' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), {K} LIMIT 1000")
def t7(spark, sf):
    return s.random_sample(points(spark, sf), 1000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 7).select(*KEY)


@query("t9_farthest_points")
def t9(spark, sf):
    return s.farthest_points(cloud(spark, sf), "label", "vec_id", 8)


@query("t10_mesh_samples", f"WITH {TRI}, a AS (SELECT vec_id, CAST(floor(sqrt((ay*bz-az*by_)**2 + (az*bx-ax*bz)**2 + (ax*by_-ay*bx)**2) / 2 * 400) AS BIGINT) AS n FROM t) SELECT vec_id, n FROM a WHERE n > 0")
def t10(spark, sf):
    v = [F.col("embedding")[i].cast("double") for i in range(6)]
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return s.mesh_samples(e, "vec_id", [F.lit(0.0)] * 3, v[:3], v[3:], 400.0).groupBy("vec_id").agg(N())


@query("e4_samples_with_noise", f"WITH {TRI}, m AS (SELECT vec_id, ay*bz-az*by_ AS nx, az*bx-ax*bz AS ny, ax*by_-ay*bx AS nz FROM t), a AS (SELECT vec_id, nz, sqrt(nx*nx + ny*ny + nz*nz) AS len FROM m) SELECT vec_id, CAST(floor(len / 2 * 400) AS BIGINT) AS n, round(0.25 * nz / len, 6) + 0.0 AS off FROM a WHERE floor(len / 2 * 400) > 0")
def e4(spark, sf):
    """Samples that a callback lifts: how far they lie off their triangles' planes."""
    v = [F.col("embedding")[i].cast("double") for i in range(6)]
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    lifted = s.mesh_samples(e, "vec_id", [F.lit(0.0)] * 3, v[:3], v[3:], 400.0, noise=lambda p, luck: (F.lit(0.0), F.lit(0.0), F.lit(0.25)))
    n = [v[1] * v[5] - v[2] * v[4], v[2] * v[3] - v[0] * v[5], v[0] * v[4] - v[1] * v[3]]
    planes = e.select("vec_id", *[c.alias(f"n{k}") for c, k in zip(n, "xyz")])
    off = (F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("z") * F.col("nz")) / F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return lifted.join(planes, "vec_id").groupBy("vec_id").agg(N(), (F.round(F.avg(off), 6) + 0.0).alias("off"))


@query("u1_union_all", f"WITH {P} SELECT seg_type, count(*) AS n FROM (SELECT * FROM p WHERE seg_type IN (1, 2) UNION ALL SELECT * FROM p WHERE z > 50) GROUP BY seg_type")
def u1(spark, sf):
    p = points(spark, sf)
    return p.where("seg_type IN (1, 2)").unionByName(p.where("z > 50")).groupBy("seg_type").agg(N())


@query("u2_union_distinct", f"WITH {P} SELECT CAST(floor(x / 50.0) AS BIGINT) AS tx, CAST(floor(y / 50.0) AS BIGINT) AS ty FROM p WHERE seg_type = 1 UNION SELECT CAST(floor(x / 50.0) AS BIGINT), CAST(floor(y / 50.0) AS BIGINT) FROM p WHERE z > 90")
def u2(spark, sf):
    t = lambda w: points(spark, sf).where(w).select(F.floor(F.col("x") / 50.0).alias("tx"), F.floor(F.col("y") / 50.0).alias("ty"))
    return t("seg_type = 1").unionByName(t("z > 90")).distinct()


@query("u4_mask_difference", f"WITH {P} SELECT CAST(floor(x / 10.0) AS BIGINT) AS cx, CAST(floor(y / 10.0) AS BIGINT) AS cy FROM p WHERE seg_type = 2 EXCEPT SELECT CAST(floor(x / 10.0) AS BIGINT), CAST(floor(y / 10.0) AS BIGINT) FROM p WHERE seg_type = 1")
def u4(spark, sf):
    c = lambda w: points(spark, sf).where(w).select(F.floor(F.col("x") / 10.0).alias("cx"), F.floor(F.col("y") / 10.0).alias("cy"))
    return c("seg_type = 2").subtract(c("seg_type = 1"))


@query("u5_inliers_and_outliers", f"WITH {P}, s AS (SELECT avg(z) AS m, stddev_samp(z) AS sd FROM p) SELECT abs(z - m) <= 1.5 * sd AS inlier, count(*) AS n FROM p, s GROUP BY 1")
def u5(spark, sf):
    p = points(spark, sf)
    stats = p.agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("sd"))
    return p.crossJoin(F.broadcast(stats)).groupBy((F.abs(F.col("z") - F.col("m")) <= 1.5 * F.col("sd")).alias("inlier")).agg(N())


@query("u6_level_of_detail_subtree", f"WITH RECURSIVE {P}, l AS (SELECT CAST(floor(x / 125.0) AS BIGINT) AS tx, CAST(floor(y / 125.0) AS BIGINT) AS ty FROM p), t AS (SELECT tx, ty, count(*) AS n FROM l GROUP BY 1, 2), r AS (SELECT 0 AS level, tx, ty, tx AS px, ty AS py, n FROM t UNION ALL SELECT level + 1, tx, ty, px // 2, py // 2, n FROM r WHERE level < 3) SELECT level, px, py, count(*) AS tiles, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2, 3")
def u6(spark, sf):
    tile = points(spark, sf).groupBy(F.floor(F.col("x") / 125.0).alias("tx"), F.floor(F.col("y") / 125.0).alias("ty")).agg(N())
    return s.subtrees(tile, 4)


@query("q_density_by_cell", f"WITH {P} SELECT CAST(floor(x / 25.0) AS BIGINT) AS cx, CAST(floor(y / 25.0) AS BIGINT) AS cy, seg_type, count(*) AS n, max(z) - min(z) AS relief FROM p WHERE display_enable GROUP BY 1, 2, 3")
def flagship(spark, sf):
    return f.visible(points(spark, sf)).groupBy(F.floor(F.col("x") / 25.0).alias("cx"), F.floor(F.col("y") / 25.0).alias("cy"), "seg_type").agg(N(), (F.max("z") - F.min("z")).alias("relief"))
