"""Queries of classification pipelines."""

from pyspark.sql import functions as F

from ..operators import classify as c, sampling as s, windows as w
from ..operators.graph import Grid
from ..sources.points import GROUND, KEY, P, points
from .aggregate_queries import PARABOLA
from .filter_queries import K
from .graph_queries import CLOSURE_2D
from .registry import query

N = "CAST(count(*) AS BIGINT) AS n"


def _pmf_sql():
    parts, name = ["g0 AS (SELECT floor(x / 5.0) AS cx, floor(y / 5.0) AS cy, min(z) AS value FROM p GROUP BY 1, 2)"], "g0"
    for i, (half, _) in enumerate(c.window_schedule(5.0, 1.0, 0.5, 3.0, 9)):
        for how, new in (("min", f"e{i}"), ("max", f"g{i + 1}")):
            parts.append(f"{new}x AS (SELECT cx, cy, {how}(value) OVER (PARTITION BY cy ORDER BY cx RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS value FROM {name}), {new} AS (SELECT cx, cy, {how}(value) OVER (PARTITION BY cx ORDER BY cy RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS value FROM {new}x)")
            name = new
    tests = " AND ".join(f"EXISTS (SELECT 1 FROM g{i + 1} g WHERE g.cx = floor(x / 5.0) AND g.cy = floor(y / 5.0) AND z - g.value < {t!r})" for i, (_, t) in enumerate(c.window_schedule(5.0, 1.0, 0.5, 3.0, 9)))
    return f"WITH {P}, {', '.join(parts)} SELECT {K} FROM p WHERE {tests}"


@query("p1_ground_filter", _pmf_sql())
def p1(spark, sf):
    return c.ground(points(spark, sf)).select(*KEY)


#: Heights above the means of ground cells, or of the ground cells up to two away: hg(point columns, hag).
HEIGHTS = """v2 AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p WHERE seg_type = 1 GROUP BY floor(x / 0.5), floor(y / 0.5), floor(z / 0.5)), hr2 AS (SELECT floor((x + 2.499995) / 5.0) AS cx, floor((y + 2.499995) / 5.0) AS cy, avg(z) AS value FROM v2 GROUP BY 1, 2),
 q2 AS (SELECT *, floor((x + 2.499995) / 5.0) AS cx, floor((y + 2.499995) / 5.0) AS cy FROM p), c2 AS (SELECT DISTINCT cx, cy FROM q2), n2 AS (SELECT c2.cx, c2.cy, avg(hr2.value) AS value FROM c2 JOIN hr2 ON abs(hr2.cx - c2.cx) <= 2 AND abs(hr2.cy - c2.cy) <= 2 GROUP BY 1, 2),
 hg AS (SELECT q2.*, CASE WHEN coalesce(hr2.value, n2.value) IS NULL THEN 0 ELSE greatest(0, z - coalesce(hr2.value, n2.value)) END AS hag FROM q2 LEFT JOIN hr2 USING (cx, cy) LEFT JOIN n2 USING (cx, cy))"""


@query("p2_normalised_heights", f"WITH {P}, {HEIGHTS} SELECT {K}, round(hag, 6) AS hag FROM hg")
def p2(spark, sf):
    return c.normalised(points(spark, sf)).select(*KEY, F.round("hag", 6).alias("hag"))


@query("p4_vegetation", f"WITH {P} SELECT CASE WHEN seg_type IN (2, 15) THEN CASE WHEN z - 2 < 20 THEN 3 WHEN z - 2 < 50 THEN 4 ELSE 15 END ELSE seg_type END AS seg_type, {N} FROM p GROUP BY 1")
def p4(spark, sf):
    v = c.vegetation(points(spark, sf).withColumn("hag", F.col("z") - 2), 20.0, 50.0)
    return v.groupBy("seg_type").agg(F.count(F.lit(1)).alias("n"))


@query("p3_tower_cells", f"WITH {P}, b AS (SELECT DISTINCT CAST(floor(x / 30.0) AS BIGINT) AS cx, CAST(floor(y / 30.0) AS BIGINT) AS cy, CAST(floor((z - 2) / 4.0) AS BIGINT) AS bin FROM p), r AS (SELECT cx, cy, count(*) * 4.0 AS runs FROM b GROUP BY 1, 2), k AS (SELECT CAST(floor(x / 30.0) AS BIGINT) AS cx, CAST(floor(y / 30.0) AS BIGINT) AS cy, max(z - 2) AS h, count(*) FILTER (z - 2 > 15) AS fn FROM p GROUP BY 1, 2 HAVING max(z - 2) >= 15), s AS (SELECT avg(fn) AS m, stddev_samp(fn) AS sd FROM k WHERE fn > 0) SELECT cx, cy, h, fn, round(runs / h, 8) AS fv FROM k JOIN r USING (cx, cy), s WHERE fn - m > 1.0 * sd AND runs / h > 0.5")
def p3(spark, sf):
    t = c.tower_cells(points(spark, sf).withColumn("hag", F.col("z") - 2), 30.0, 15.0, 4.0, 1.0, 0.5)
    return t.withColumn("fv", F.round("fv", 8))


@query("p4b_road_regions", f"WITH RECURSIVE {P}, k AS (SELECT row_number() OVER (ORDER BY floor(x / 25.0), floor(y / 25.0)) AS id, floor(x / 25.0) AS x, floor(y / 25.0) AS y, max(z) AS top FROM p WHERE seg_type = 1 GROUP BY floor(x / 25.0), floor(y / 25.0) HAVING max(z) - min(z) <= 20), {CLOSURE_2D.format(' AND abs(a.top - b.top) < 10')}, s AS (SELECT component, count(*) * 625.0 AS area FROM l GROUP BY component) SELECT CAST(k.x AS BIGINT) AS cx, CAST(k.y AS BIGINT) AS cy FROM l JOIN k USING (id) JOIN s USING (component) WHERE area >= 1250 AND area < 1000000")
def p4b(spark, sf):
    return c.road_regions(points(spark, sf).where(F.col("seg_type") == GROUND), 25.0, 20.0, 10.0, (1250.0, 1e6)).select("cx", "cy")


@query("p5_tree_crowns")
def p5(spark, sf):
    tops = s.cell_tops(points(spark, sf).where("seg_type IN (2, 15)"), 10.0, KEY)
    tops = tops.withColumn("id", Grid.of(tops, ("cx", "cy")).id())
    seeds = w.local_maxima(tops.select("id", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), "z"), F.lit(2.0), 2.0, "id").select("id", F.lit(True).alias("is_seed"))
    seeded = tops.join(seeds, "id", "left").withColumn("seed", F.when(F.col("is_seed"), F.col("id") + 1).otherwise(0))
    return c.crowns(seeded.select("cx", "cy", "z", "seed"), 10.0, 0.45, 0.55, 4)


@query("p11_sampled_curves", f"WITH {P}, b AS (SELECT cluster_id, min(y) AS y1, max(y) AS y2 FROM p WHERE seg_type = 4 GROUP BY cluster_id), {PARABOLA.format('cluster_id', 'p WHERE seg_type = 4')}, w AS (SELECT cluster_id, y1 + 10.0 * unnest(range(CAST(floor((y2 - y1) / 10.0) + 1 AS BIGINT))) AS y FROM b) SELECT cluster_id, {N}, round(sum(y), 3) AS y, round(sum(a * y * y + b * y + c) / 1000, 6) AS z FROM w JOIN fit USING (cluster_id) WHERE a IS NOT NULL GROUP BY cluster_id")
def p11(spark, sf):
    from ..operators.aggregates import parabola_fit

    p = points(spark, sf).where("seg_type = 4")
    fits = parabola_fit(p, "cluster_id").join(p.groupBy("cluster_id").agg(F.min("y").alias("y_min"), F.max("y").alias("y_max")), "cluster_id")
    return c.sampled_curve(fits.drop("n"), 10.0).where("z is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 3).alias("y"), F.round(F.sum("z") / 1000, 6).alias("z"))


@query("p15_training_blocks", f"WITH {P}, b AS (SELECT x, y, z, seg_type, unnest(range(CAST(floor((x - 100) / 80.0) + 1 AS BIGINT), CAST(floor(x / 80.0) AS BIGINT) + 1)) AS bx FROM p), d AS (SELECT *, unnest(range(CAST(floor((y - 100) / 80.0) + 1 AS BIGINT), CAST(floor(y / 80.0) AS BIGINT) + 1)) AS by_ FROM b) SELECT bx, by_, {N} FROM d GROUP BY bx, by_ HAVING bool_or(seg_type IN (3, 4))")
def p15(spark, sf):
    b = c.blocks(points(spark, sf), 100.0, 20.0)
    return b.groupBy("bx", "by_").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("seg_type").isin(3, 4)).alias("wanted")).where("wanted").drop("wanted")


@query("p15_unit_spheres", f"WITH {P}, m AS (SELECT cluster_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p GROUP BY cluster_id), d AS (SELECT cluster_id, sqrt((x-mx)**2 + (y-my)**2 + (z-mz)**2) AS r FROM p JOIN m USING (cluster_id)) SELECT cluster_id, round(avg(r) / max(r), 6) AS mean_r FROM d GROUP BY cluster_id")
def p15_sphere(spark, sf):
    u = c.unit_sphere(points(spark, sf).select("cluster_id", "x", "y", "z"), "cluster_id")
    return u.groupBy("cluster_id").agg(F.round(F.avg(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))), 6).alias("mean_r"))


@query("p16_softmax_and_argmax", "WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT vec_id, CAST(arg_max(i, (v, -i)) - 1 AS BIGINT) AS best, round(exp(max(v)) / sum(exp(v)), 8) AS share FROM s GROUP BY vec_id")
def p16(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return e.select("vec_id", c.argmax(F.col("v")).alias("best"), F.round(F.array_max(c.softmax(F.col("v"))), 8).alias("share"))
