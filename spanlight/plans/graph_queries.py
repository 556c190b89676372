"""Queries of clustering and denoising. Components are compared by sizes and least members, which don't depend on how ids are formed."""

from pyspark.sql import functions as F

from ..operators import graph as c
from ..operators.windows import numbered
from ..sources.points import E, KEY, P, cloud, points
from .registry import query

N = "CAST(count(*) AS BIGINT) AS n"
#: Reachability by recursion over the table k(id, x, y[, z]) of cells.
CLOSURE_2D = "e AS (SELECT a.id AS u, b.id AS v FROM k a JOIN k b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1{0}), w AS (SELECT id, id AS root FROM k UNION SELECT e.v, w.root FROM w JOIN e ON e.u = w.id), l AS (SELECT id, min(root) AS component FROM w GROUP BY id)"


@query("c1_euclidean_clusters", f"WITH RECURSIVE {E}, g AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.05*0.05), w AS (SELECT vec_id AS id, vec_id AS root FROM e UNION SELECT g.v, w.root FROM w JOIN g ON g.u = w.id), l AS (SELECT id, min(root) AS component FROM w GROUP BY id) SELECT component, {N} FROM l GROUP BY component HAVING count(*) BETWEEN 2 AND 100000")
def c1(spark, sf):
    e = c.sized(c.euclidean_components(cloud(spark, sf), "vec_id", 0.05), 2, 100_000, True)
    return e.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


VOXELS = "v AS (SELECT floor(x / 2.0) AS x, floor(y / 2.0) AS y, floor(z / 2.0) AS z, count(*) AS n FROM p WHERE {0} GROUP BY 1, 2, 3), k AS (SELECT row_number() OVER (ORDER BY x, y, z) AS id, * FROM v)"
CLOSURE_3D = "o AS (SELECT unnest([-1, 0, 1]) AS d), g AS (SELECT a.id AS u, b.id AS v FROM k a CROSS JOIN o i CROSS JOIN o j CROSS JOIN o h JOIN k b ON b.x = a.x + i.d AND b.y = a.y + j.d AND b.z = a.z + h.d), w AS (SELECT id, id AS root FROM k UNION SELECT g.v, w.root FROM w JOIN g ON g.u = w.id), l AS (SELECT id, min(root) AS component FROM w GROUP BY id), s AS (SELECT component, sum(k.n) AS size FROM l JOIN k USING (id) GROUP BY component)"


@query("c2_voxel_clusters", f"WITH RECURSIVE {P}, {VOXELS.format('true')}, {CLOSURE_3D} SELECT CAST(k.x AS BIGINT) AS x, CAST(k.y AS BIGINT) AS y, CAST(k.z AS BIGINT) AS z, CAST(size AS BIGINT) AS size FROM s JOIN k ON k.id = component WHERE size >= 3 AND size < 1000")
def c2(spark, sf):
    p = points(spark, sf).select("x", "y", "z")
    grid = c.Grid.of_points(p, 2.0)
    kept = c.voxel_clusters(p, 2.0, 3, 1000, False, grid=grid)
    return kept.groupBy("component").agg(F.count(F.lit(1)).alias("size")).select(*grid.cell(F.col("component"), *"xyz"), "size")


@query("c4_denoise_by_size", f"WITH RECURSIVE {P}, {VOXELS.format('true')}, {CLOSURE_3D} SELECT CAST(k.x AS BIGINT) AS x, CAST(k.y AS BIGINT) AS y, CAST(k.z AS BIGINT) AS z, size < 3 AS outlier, CAST(size AS BIGINT) AS n FROM s JOIN k ON k.id = component")
def c4(spark, sf):
    p = points(spark, sf).select("x", "y", "z")
    grid = c.Grid.of_points(p, 2.0)
    d = c.denoise_by_size(p, 2.0, 3, grid)
    return d.groupBy("component", "outlier").agg(F.count(F.lit(1)).alias("n")).select(*grid.cell(F.col("component"), *"xyz"), "outlier", "n")


@query("c5_statistical_denoise", f"WITH {E}, d AS (SELECT a.vec_id, b.vec_id AS other, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, other) AS rank FROM d), m AS (SELECT vec_id, avg(sqrt(d2)) AS d FROM r WHERE rank <= 8 GROUP BY vec_id), s AS (SELECT avg(d) AS a, stddev_samp(d) AS sd FROM m) SELECT vec_id, round(d, 8) AS d, d > a + 1.5 * sd AS outlier FROM m, s")
def c5(spark, sf):
    return c.denoise_statistical(cloud(spark, sf), "vec_id", 8, 1.5, 0.1).withColumn("d", F.round("d", 8))


@query("c6_denoise_by_radius", f"WITH {P}, v AS (SELECT *, count(*) OVER (PARTITION BY floor(x / 30.0), floor(y / 30.0), floor(z / 30.0)) AS n FROM p) SELECT {', '.join(KEY)} FROM v WHERE n > 12")
def c6(spark, sf):
    return c.denoise_radius(points(spark, sf), 15.0, 12).select(*KEY)


CELLS = "k AS (SELECT row_number() OVER (ORDER BY floor(x / 40.0), floor(y / 40.0)) AS id, floor(x / 40.0) AS x, floor(y / 40.0) AS y, {0} AS top FROM p WHERE {1} GROUP BY floor(x / 40.0), floor(y / 40.0))"


@query("c7_grown_regions", f"WITH RECURSIVE {P}, {CELLS.format('avg(z)', 'true')}, {CLOSURE_2D.format(' AND abs(a.top - b.top) < 4')}, s AS (SELECT component, count(*) AS size FROM l GROUP BY component) SELECT CAST(k.x AS BIGINT) AS x, CAST(k.y AS BIGINT) AS y, CAST(size AS BIGINT) AS size FROM s JOIN k ON k.id = component")
def c7(spark, sf):
    cells = points(spark, sf).groupBy(F.floor(F.col("x") / 40.0).alias("cx"), F.floor(F.col("y") / 40.0).alias("cy")).agg(F.avg("z").alias("top"))
    grid = c.Grid.of(cells, ("cx", "cy"))
    return c.grown_regions(cells, "top", 4.0, grid).groupBy("component").agg(F.count(F.lit(1)).alias("size")).select(*grid.cell(F.col("component"), "x", "y"), "size")


@query("c11_raster_components", f"WITH RECURSIVE {P}, {CELLS.format('0', 'seg_type = 3').replace('40.0', '4.0')}, {CLOSURE_2D.format('')}, s AS (SELECT component, count(*) AS size FROM l GROUP BY component) SELECT CAST(k.x AS BIGINT) AS x, CAST(k.y AS BIGINT) AS y, CAST(size AS BIGINT) AS size FROM s JOIN k ON k.id = component")
def c11(spark, sf):
    cells = points(spark, sf).where("seg_type = 3").groupBy(F.floor(F.col("x") / 4.0).alias("cx"), F.floor(F.col("y") / 4.0).alias("cy")).agg(F.lit(0.0).alias("top"))
    grid = c.Grid.of(cells, ("cx", "cy"))
    return c.grown_regions(cells, "top", 1.0, grid).groupBy("component").agg(F.count(F.lit(1)).alias("size")).select(*grid.cell(F.col("component"), "x", "y"), "size")


@query("c15_cluster_registry", f"WITH {P} SELECT cluster_id, seg_type, count(*) AS n, row_number() OVER (ORDER BY cluster_id, seg_type) AS item FROM p GROUP BY cluster_id, seg_type")
def c15(spark, sf):
    t = points(spark, sf).groupBy("cluster_id", "seg_type").agg(F.count(F.lit(1)).alias("n"))
    return numbered(t, [F.col("cluster_id"), F.col("seg_type")], "item")


@query("c16_cluster_boxes", f"WITH RECURSIVE {P}, {VOXELS.format('true')}, {CLOSURE_3D}, q AS (SELECT l.component, p.* FROM p JOIN k ON k.x = floor(p.x / 2.0) AND k.y = floor(p.y / 2.0) AND k.z = floor(p.z / 2.0) JOIN l USING (id)) SELECT min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, {N} FROM q GROUP BY component HAVING count(*) >= 3")
def c16(spark, sf):
    kept = c.voxel_clusters(points(spark, sf).select("x", "y", "z"), 2.0, 3, 1 << 60, True)
    return kept.groupBy("component").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count(F.lit(1)).alias("n")).drop("component")
