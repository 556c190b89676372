"""Queries of curve, plane and line fits and of registration."""

from pyspark.sql import functions as F

from ..operators import fits, graph, registration
from ..sources.points import E, KEY, P, cloud, points
from ..sources.staging import scratch, written
from .aggregate_queries import PARABOLA
from .registry import query

#: Wires of class 4 by cluster: main direction, place along it, parabola; wt(cluster_id, x, y, z, t, ...), fit over t.
WIRES = f"wp AS (SELECT cluster_id, x, y, z FROM p WHERE seg_type = 4), ax AS (SELECT cluster_id, avg(x) AS mx, avg(y) AS my, cos(atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)) / 2) AS ux, sin(atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)) / 2) AS uy FROM wp GROUP BY cluster_id), wt AS (SELECT cluster_id, z, (x - mx) * ux + (y - my) * uy AS y FROM wp JOIN ax USING (cluster_id)), {PARABOLA.format('cluster_id', 'wt')}, r AS (SELECT cluster_id, min(y) AS t1, max(y) AS t2 FROM wt GROUP BY cluster_id)"


@query("a31_wire_fits", f"WITH {P}, {WIRES} SELECT cluster_id, n, round(ux, 6) AS ux, round(uy, 6) AS uy, round(a * 1e6, 3) AS a, round(b * 1e3, 4) AS b, round(c, 5) AS c, round(t1, 4) AS t1, round(t2, 4) AS t2 FROM fit JOIN ax USING (cluster_id) JOIN r USING (cluster_id)")
def a31(spark, sf):
    f = fits.wire_fit(points(spark, sf).where("seg_type = 4"), "cluster_id")
    return f.select("cluster_id", "n", F.round("ux", 6).alias("ux"), F.round("uy", 6).alias("uy"), F.round(F.col("a") * 1e6, 3).alias("a"), F.round(F.col("b") * 1e3, 4).alias("b"), F.round("c", 5).alias("c"), F.round("t1", 4).alias("t1"), F.round("t2", 4).alias("t2"))


@query("p10_curve_fitting", f"WITH {P}, {WIRES}, s AS (SELECT cluster_id, t1 + 20.0 * unnest(range(CAST(floor((t2 - t1) / 20.0) AS BIGINT) + 1)) AS t FROM r) SELECT cluster_id, round(mx + t * ux, 4) AS x, round(my + t * uy, 4) AS y, round(a * t * t + b * t + c, 4) AS z FROM s JOIN fit USING (cluster_id) JOIN ax USING (cluster_id) WHERE a IS NOT NULL")
def p10(spark, sf):
    f = fits.wire_fit(points(spark, sf).where("seg_type = 4"), "cluster_id").where("a is not null")
    return fits.wire_points(f, 20.0).select("cluster_id", *[F.round(c, 4).alias(c) for c in "xyz"])


@query("a30_degree_seven_fit")
def a30(spark, sf):
    """Tested against a plain least-squares fit."""
    f = fits.polynomial_fit(points(spark, sf).where("seg_type = 4"), "cluster_id", 7)
    at = f.withColumn("y", F.explode(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda i: F.col("middle") + F.col("half") * i / 4)))
    return at.select("cluster_id", "n", F.round("y", 6).alias("y"), F.round(fits.polynomial_at(F.col("y")), 5).alias("z"))


TRY = "md5(concat_ws('|', '0', CAST(try AS VARCHAR), CAST(vec_id AS VARCHAR)))"


def tries(n, parts):
    hit = ", ".join(f"arg_min(struct_pack(x := x, y := y, z := z), h) FILTER (('0x' || substr(h, 1, 4))::INT % {parts} = {i}) AS p{i}" for i in range(parts))
    return f"k AS (SELECT e.*, unnest(range({n})) AS try FROM e), hh AS (SELECT *, {TRY} AS h FROM k), pk AS (SELECT label, try, {hit} FROM hh GROUP BY label, try HAVING {' AND '.join(f'p{i} IS NOT NULL' for i in range(parts))})"


@query("a32_planes", f"""WITH {E}, {tries(12, 3)}, n AS (SELECT label, try, p0, (p1.y - p0.y) * (p2.z - p0.z) - (p1.z - p0.z) * (p2.y - p0.y) AS nx, (p1.z - p0.z) * (p2.x - p0.x) - (p1.x - p0.x) * (p2.z - p0.z) AS ny, (p1.x - p0.x) * (p2.y - p0.y) - (p1.y - p0.y) * (p2.x - p0.x) AS nz FROM pk),
 u AS (SELECT label, try, nx / sqrt(nx * nx + ny * ny + nz * nz) AS nx, ny / sqrt(nx * nx + ny * ny + nz * nz) AS ny, nz / sqrt(nx * nx + ny * ny + nz * nz) AS nz, p0 FROM n WHERE nx * nx + ny * ny + nz * nz > 0), d AS (SELECT *, nx * p0.x + ny * p0.y + nz * p0.z AS d FROM u),
 s AS (SELECT label, try, count(*) FILTER (abs(nx * x + ny * y + nz * z - d) <= 0.04) AS inliers FROM e JOIN d USING (label) GROUP BY 1, 2)
 SELECT label, round(nx, 7) AS nx, round(ny, 7) AS ny, round(nz, 7) AS nz, round(d, 7) AS d, inliers FROM s JOIN d USING (label, try) QUALIFY row_number() OVER (PARTITION BY label ORDER BY inliers DESC, try) = 1""")
def a32(spark, sf):
    b = fits.best_planes(cloud(spark, sf), "label", ["vec_id"], 0.04, 12)
    return b.select("label", *[F.round(c, 7).alias(c) for c in ("nx", "ny", "nz", "d")], "inliers")


@query("a32_planes_one_after_another")
def a32_rounds(spark, sf):
    """Tested on planes that are known."""
    base = scratch(spark, "planes")
    f = fits.planes(cloud(spark, sf), "label", ["vec_id"], 0.04, 10, 3, lambda df, n: written(df, base, n), 12)
    return f.select("label", "round", *[F.round(c, 7).alias(c) for c in ("nx", "ny", "nz", "d")], "inliers")


@query("a33_lines", f"""WITH {E}, {tries(12, 2)}, u AS (SELECT label, try, (p1.x - p0.x) / sqrt((p1.x - p0.x)**2 + (p1.y - p0.y)**2) AS ux, (p1.y - p0.y) / sqrt((p1.x - p0.x)**2 + (p1.y - p0.y)**2) AS uy, p0.x AS mx, p0.y AS my FROM pk WHERE p1.x <> p0.x OR p1.y <> p0.y),
 s AS (SELECT label, try, count(*) FILTER (abs((y - my) * ux - (x - mx) * uy) <= 0.03) AS inliers FROM e JOIN u USING (label) GROUP BY 1, 2), b AS (SELECT * FROM s JOIN u USING (label, try) QUALIFY row_number() OVER (PARTITION BY label ORDER BY inliers DESC, try) = 1),
 o AS (SELECT label, inliers, x, y FROM e JOIN b USING (label) WHERE abs((y - my) * ux - (x - mx) * uy) <= 0.03)
 SELECT label, any_value(inliers) AS inliers, round(avg(x), 7) AS mx, round(avg(y), 7) AS my, round(cos(atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)) / 2), 6) AS ux, round(sin(atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)) / 2), 6) AS uy FROM o GROUP BY label""")
def a33(spark, sf):
    b = fits.best_lines(cloud(spark, sf), "label", ["vec_id"], 0.03, 12)
    return b.select("label", "inliers", F.round("mx", 7).alias("mx"), F.round("my", 7).alias("my"), F.round("ux", 6).alias("ux"), F.round("uy", 6).alias("uy"))


@query("p12_tile_directions", f"WITH {P}, t AS (SELECT CAST(floor(x / 125.0) AS BIGINT) AS tx, CAST(floor(y / 125.0) AS BIGINT) AS ty, x, y FROM p) SELECT tx, ty, round(cos(atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)) / 2), 6) AS ux, round(sin(atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)) / 2), 6) AS uy, count(*) AS n FROM t GROUP BY 1, 2")
def p12(spark, sf):
    p = points(spark, sf).withColumn("tx", F.floor(F.col("x") / 125.0)).withColumn("ty", F.floor(F.col("y") / 125.0))
    axis = fits.plane_axis(p, "tx", "ty").join(p.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n")), ["tx", "ty"])
    return axis.select("tx", "ty", F.round("ux", 6).alias("ux"), F.round("uy", 6).alias("uy"), "n")


@query("p14_registration")
def p14(spark, sf):
    """The cloud turned and shifted a little, and registered back; tested on known motions."""
    base, e = scratch(spark, "registration"), cloud(spark, sf)
    turned = fits.moved(e.select("vec_id", "x", "y", "z"), [[0.9998, -0.02, 0.0], [0.02, 0.9998, 0.0], [0.0, 0.0, 1.0]], [0.004, -0.003, 0.002])
    at, _ = fits.registered(turned, e.select("vec_id", "x", "y", "z"), "vec_id", "vec_id", lambda df, n: written(df, base, n), 12, robust=0.1)
    return at.select("vec_id", *[F.round(c, 4).alias(c) for c in "xyz"])


def _turned(spark, sf):
    e = cloud(spark, sf).select("vec_id", "x", "y", "z")
    return fits.moved(e, [[0.9998, -0.02, 0.0], [0.02, 0.9998, 0.0], [0.0, 0.0, 1.0]], [0.004, -0.003, 0.002]), e


@query("p14_registration_to_planes")
def p14_planes(spark, sf):
    """The turned cloud registered to the tangent planes of the other; tested on known motions."""
    base, (turned, e) = scratch(spark, "registration"), _turned(spark, sf)
    at, _, _ = registration.aligned(turned, e, "vec_id", "vec_id", lambda df, n: written(df, base, n), "planes", 4, flat=0.2, robust=0.05)
    return at.select("vec_id", *[F.round(c, 4).alias(c) for c in "xyz"])


@query("p14_sparse_registration")
def p14_sparse(spark, sf):
    """The same by sums of small powers of the distances; tested on known motions with wrong points."""
    base, (turned, e) = scratch(spark, "registration"), _turned(spark, sf)
    at, _, _ = registration.aligned(turned, e, "vec_id", "vec_id", lambda df, n: written(df, base, n), "sparse", 3)
    return at.select("vec_id", *[F.round(c, 4).alias(c) for c in "xyz"])


@query("c10_merged_positions", "WITH RECURSIVE t AS (SELECT s_suppkey AS id, s_acctbal / 100.0 AS x, CAST(s_suppkey % 37 AS DOUBLE) AS y FROM supplier), e AS (SELECT a.id AS u, b.id AS v FROM t a JOIN t b ON (a.x-b.x)**2 + (a.y-b.y)**2 <= 9), w AS (SELECT id, id AS root FROM t UNION SELECT e.v, w.root FROM w JOIN e ON e.u = w.id), l AS (SELECT id, min(root) AS component FROM w GROUP BY id) SELECT component, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM l JOIN t USING (id) GROUP BY component")
def c10(spark, sf):
    t = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey AS id", "s_acctbal / 100.0D AS x", "CAST(s_suppkey % 37 AS DOUBLE) AS y", "0.0D AS z")
    m = graph.merged_positions(t, "id", 3.0)
    return m.select("component", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


GROWN = "k AS (SELECT row_number() OVER (ORDER BY floor(x / 40.0), floor(y / 40.0)) AS id, CAST(floor(x / 40.0) AS BIGINT) AS x, CAST(floor(y / 40.0) AS BIGINT) AS y, avg(z) AS top FROM p GROUP BY floor(x / 40.0), floor(y / 40.0))"


@query("c14_directed_growing", f"WITH RECURSIVE {P}, {GROWN}, e AS (SELECT a.id AS u, b.id AS v FROM k a JOIN k b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id AND b.top <= a.top), w AS (SELECT id, 0 AS seed FROM k WHERE top > 55 UNION SELECT e.v, 0 FROM w JOIN e ON e.u = w.id) SELECT x AS cx, y AS cy FROM w JOIN k USING (id)")
def c14(spark, sf):
    """From high cells over neighbours that aren't higher."""
    cells = points(spark, sf).groupBy(F.floor(F.col("x") / 40.0).alias("cx"), F.floor(F.col("y") / 40.0).alias("cy")).agg(F.avg("z").alias("top"))
    return graph.grown_from(cells, F.col("top") > 55, F.col("n_top") <= F.col("top"), ("top",)).select("cx", "cy")
