"""Queries of power corridors, buildings, orchestration, callbacks, and of ranges and octree cells."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import corridor as c, fits, graph, terrain
from ..operators import classify
from ..sources.files import Options
from ..sources.points import GROUND, KEY, P, points
from ..sources.staging import scratch, written
from .classify_queries import HEIGHTS, _pmf_sql
from .filter_queries import INSIDE, K, RING, SIDES
from .registry import query

OPTIONS = "[Options]\ncell = 5\nlow_height = 20\nhigh_height = 50\nkinds = ground, vegetation\n"


#: What the corridor and its buildings read of a point.
PLACE = ("x", "y", "z", "seg_type")


def with_id(spark, sf, *columns):
    """Points (with all columns unless some are named) with one key: a number of the row, written so that it stays."""
    return written(points(spark, sf).select(*columns or "*").withColumn("id", F.monotonically_increasing_id()), scratch(spark, "numbered"), "points")


def heights(spark, sf):
    return classify.normalised(with_id(spark, sf, *PLACE))


@query("p9_tower_positions")
def p9(spark, sf):
    """Heights above ground and tower positions; tested on a line of known towers."""
    # no numbers of points are asked for, so only what the cells need is written
    h = written(classify.normalised(points(spark, sf).select("x", "y", "z", "seg_type")).select("x", "y", "hag"), scratch(spark, "heights"), "points")
    t = c.tower_positions(h, 30.0, 15.0)
    return t.select("tower", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("height", 6).alias("height"))


@query("p3d_wires")
def p3d(spark, sf):
    """Wires between the clusters' first points as towers; tested on known wires."""
    h = heights(spark, sf)
    t = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_nationkey + 1 AS tower", "n_nationkey * 40.0D + 20 AS x", "n_nationkey * 37.0D % 900 + 20 AS y")
    f, _ = c.wires(h, c.spans(t), "id", least=3, linearity=0.5, within=2.0)
    return f.select("span", "component", "n", F.round("ux", 6).alias("ux"), F.round("uy", 6).alias("uy"))


@query("p3_corridor")
def p3(spark, sf):
    """Classes after towers and wires; tested on a known corridor."""
    h = written(heights(spark, sf), scratch(spark, "heights"), "points")
    return c.corridor(h, "id", 30.0, 15.0, least=3, linearity=0.5).groupBy("seg_type").agg(F.count(F.lit(1)).alias("n"))


@query("p3f_hang_points")
def p3f(spark, sf):
    h = heights(spark, sf)
    t = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_nationkey + 1 AS tower", "n_nationkey * 40.0D + 20 AS x", "n_nationkey * 37.0D % 900 + 20 AS y")
    s = c.spans(t)
    f, _ = c.wires(h, s, "id", least=3, linearity=0.5, within=2.0)
    return c.hang_points(f, s).select("span", "component", "side", *[F.round(v, 4).alias(v) for v in "xyz"])


@query("p4a_buildings")
def p4a(spark, sf):
    """Roofs among points high above the triangulated terrain; tested on known roofs."""
    return c.buildings(terrain.normalised(with_id(spark, sf, *PLACE), GROUND, 0.5, 5.0), "id", voxel=8.0, least=10, within=2.0, share=0.3).agg(F.count(F.lit(1)).alias("n"))


@query("p8_steep_regions")
def p8(spark, sf):
    surface = points(spark, sf).groupBy(F.floor(F.col("x") / 20.0).alias("cx"), F.floor(F.col("y") / 20.0).alias("cy")).agg(F.min("z").alias("value"))
    return c.steep_regions(surface, 20.0, 5.0, 400.0)


GROUND_SQL = _pmf_sql()
PMF_PARTS, PMF_TESTS = GROUND_SQL[len(f"WITH {P}, "):].split(f" SELECT {K} FROM p WHERE ")


@query("p18_auto_segment", f"WITH {P}, {PMF_PARTS}, {SIDES}, s1 AS (SELECT *, CASE WHEN {PMF_TESTS} THEN 1 WHEN seg_type = 1 THEN 255 ELSE seg_type END AS st FROM p), "
       + HEIGHTS.replace("FROM p WHERE seg_type = 1", "FROM s1 WHERE st = 1").replace("FROM p), c2", "FROM s1), c2")
       + f", s2 AS (SELECT *, CASE WHEN st IN (2, 15, 255) THEN CASE WHEN hag < 20 THEN 3 WHEN hag < 50 THEN 4 ELSE 15 END ELSE st END AS nt FROM hg), s3 AS (SELECT *, display_enable AND {INSIDE} AS inside, CASE WHEN nt = 15 THEN 2 ELSE nt END AS target FROM s2)"
       + f" SELECT {K}, CASE WHEN inside AND target IN (1, 2, 3) THEN target ELSE seg_type END AS seg_type FROM s3")
def p18(spark, sf):
    """Options from text, ground and vegetation one after the other, written back inside a polygon."""
    out = c.segmented(with_id(spark, sf), "id", Options.read(OPTIONS), RING, [1, 2, 3])
    return out.select(*KEY, "seg_type")


@query("e1_visited", f"WITH {P} SELECT count(*) AS n, max(z) AS top, min(x) AS left_ FROM p WHERE seg_type = 4 AND z > 30")
def e1(spark, sf):
    return c.visited(points(spark, sf), lambda p: (p["seg_type"] == 4) & (p["z"] > 30), {"n": lambda p: F.count(F.lit(1)), "top": lambda p: F.max(p["z"]), "left_": lambda p: F.min(p["x"])})


@query("e1_first_visited", f"WITH {P} SELECT count(*) AS n, max(z) AS z FROM (SELECT * FROM p WHERE seg_type = 4 AND z > 30 ORDER BY x, {K} LIMIT 1)")
def e1_first(spark, sf):
    return c.visited(points(spark, sf), lambda p: (p["seg_type"] == 4) & (p["z"] > 30), {"n": lambda p: F.count(F.lit(1)), "z": lambda p: F.max(p["z"])}, ["x", *KEY])


@query("e2_remapped_by_function", f"WITH {P} SELECT CASE WHEN seg_type IN (1, 2, 3, 4) THEN (seg_type * 7) % 5 + 10 ELSE seg_type END AS seg_type, count(*) AS n FROM p GROUP BY 1")
def e2(spark, sf):
    return c.remapped_by(points(spark, sf), lambda k: k * 7 % 5 + 10, [1, 2, 3, 4]).groupBy("seg_type").agg(F.count(F.lit(1)).alias("n"))


@query("e5_visited_cells", f"WITH {P} SELECT CAST(floor(x / 50.0) AS BIGINT) AS cx, CAST(floor(y / 50.0) AS BIGINT) AS cy, round(quantile_cont(z, 0.5), 6) AS middle FROM p GROUP BY 1, 2")
def e5(spark, sf):
    import pandas as pd

    def visit(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cx": [rows["cx"].iloc[0]], "cy": [rows["cy"].iloc[0]], "middle": [round(float(rows["z"].median()), 6)]})

    return c.visited_cells(points(spark, sf).select("x", "y", "z"), 50.0, visit, "cx long, cy long, middle double")


@query("g4_ranges", f"WITH {P} SELECT cluster_id, round(max(x * 0.6 + y * 0.8), 6) AS reach, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM p GROUP BY cluster_id")
def g4(spark, sf):
    """Farthest projection on a direction, and the bounds of the same points as a ring."""
    ends = points(spark, sf).groupBy("cluster_id").agg(F.round(F.max(g.projection(F.col("x"), F.col("y"), (0.6, 0.8))), 6).alias("reach"), F.array_distinct(F.array(F.min(F.struct("x", "y")), F.max(F.struct("x", "y")), F.min_by(F.struct("x", "y"), "y"), F.max_by(F.struct("x", "y"), "y"))).alias("ring"))
    return ends.select("cluster_id", "reach", *g.ring_bounds(F.col("ring")))


@query("g12_octree_cells", f"WITH {P}, k AS (SELECT DISTINCT CAST(floor(x / 125.0) AS BIGINT) AS i, CAST(floor(y / 125.0) AS BIGINT) AS j, CAST(floor(z / 125.0) AS BIGINT) AS l FROM p) SELECT list_sum(list_transform(range(0, 10), lambda b: (((i >> b) & 1) << (3 * b)) | (((j >> b) & 1) << (3 * b + 1)) | (((l >> b) & 1) << (3 * b + 2))))::BIGINT AS key, i * 125.0 AS x1, j * 125.0 AS y1, l * 125.0 AS z1, i * 125.0 + 125 AS x2, j * 125.0 + 125 AS y2, l * 125.0 + 125 AS z2 FROM k")
def g12(spark, sf):
    key = g.octree_key(*[F.floor(F.col(a) / 125.0) for a in "xyz"], 10)
    return points(spark, sf).select(key.alias("key")).distinct().select("key", *g.octree_box(F.col("key"), 125.0, 10))
