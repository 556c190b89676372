"""Queries of filters, predicates, scans and sinks."""

import re

from pyspark.sql import functions as F

from ..functions import geometry as g, properties as prop
from ..operators import filters as f
from ..sources.points import KEY, P, points
from .registry import query

K = ", ".join(KEY)
RING = [(100.0, 100.0), (700.0, 150.0), (900.0, 600.0), (400.0, 900.0), (150.0, 500.0)]
SIDES = "s AS (SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in g.edges(RING)) + ") AS v(x1, y1, x2, y2))"
HIT = "y >= least(y1, y2) AND y < greatest(y1, y2) AND y1 <> y2 AND (y - y1) * (x2 - x1) / (y2 - y1) + x1 > x"
INSIDE = f"(SELECT count(*) FROM s WHERE {HIT}) % 2 = 1"


@query("f1_range", f"WITH {P} SELECT {K}, z FROM p WHERE z BETWEEN 10 AND 40")
def f1(spark, sf):
    return f.field_range(points(spark, sf), "z", 10, 40).select(*KEY, "z")


@query("f2_class", f"WITH {P} SELECT {K}, x, y, z FROM p WHERE seg_type = 3")
def f2(spark, sf):
    return f.of_class(points(spark, sf), 3).select(*KEY, "x", "y", "z")


@query("f3_class_in_half_open_box", f"WITH {P} SELECT {K} FROM p WHERE seg_type = 1 AND x >= 100 AND x < 600 AND y >= 50 AND y < 400")
def f3(spark, sf):
    return f.of_class(points(spark, sf), 1, (100, 50, 600, 400)).select(*KEY)


@query("f4_set_classification", f"WITH {P} SELECT CASE WHEN z > 80 THEN 6 ELSE seg_type END AS seg_type, count(*) AS n FROM p GROUP BY 1")
def f4(spark, sf):
    return f.relabel(points(spark, sf), 6, F.col("z") > 80).groupBy("seg_type").agg(F.count(F.lit(1)).alias("n"))


@query("f5_subset", f"WITH {P} SELECT {K} FROM p WHERE cluster_id IN (SELECT CAST(s_suppkey AS INT) FROM supplier WHERE s_nationkey = 3)")
def f5(spark, sf):
    chosen = spark.read.parquet(f"{sf}/supplier.parquet").where("s_nationkey = 3").selectExpr("CAST(s_suppkey AS INT) AS cluster_id")
    return f.subset(points(spark, sf), chosen, ["cluster_id"]).select(*KEY)


@query("f6_closed_box", f"WITH {P} SELECT {K} FROM p WHERE x BETWEEN 200 AND 500 AND y BETWEEN 200 AND 500")
def f6(spark, sf):
    return points(spark, sf).where(g.in_box(F.col("x"), F.col("y"), (200, 200, 500, 500))).select(*KEY)


BOXES = f"b AS (SELECT cluster_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM p GROUP BY cluster_id)"


@query("f7_box_relations", f"WITH {P}, {BOXES} SELECT cluster_id, x1 <= 300 AND y1 <= 300 AND x2 >= 400 AND y2 >= 400 AS holds, x1 < 400 AND 300 < x2 AND y1 < 400 AND 300 < y2 AS meets, greatest(least(x2, 400) - greatest(x1, 300), 0) * greatest(least(y2, 400) - greatest(y1, 300), 0) AS common FROM b")
def f7(spark, sf):
    b = points(spark, sf).groupBy("cluster_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    own, fixed = [F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.lit(float(v)) for v in (300, 300, 400, 400)]
    return b.select("cluster_id", g.box_contains(own, fixed).alias("holds"), g.boxes_intersect(own, fixed).alias("meets"), g.overlap_area(own, fixed).alias("common"))


#: Half a cent goes up by the decimal digits of a number, as in Spark; DuckDB's round of doubles multiplies by 100 first, which puts it on either side.
HALF_UP = "CAST(round(CAST(CAST({0} AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) AS {0}"


@query("f8_boxes_by_rounded_corner", f"WITH {P}, {BOXES} SELECT {HALF_UP.format('x1')}, {HALF_UP.format('y1')}, count(*) AS n FROM b GROUP BY ALL")
def f8(spark, sf):
    b = points(spark, sf).groupBy("cluster_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"))
    return b.groupBy(F.round("x1", 2).alias("x1"), F.round("y1", 2).alias("y1")).agg(F.count(F.lit(1)).alias("n"))


@query("f9_point_in_polygon", f"WITH {P}, {SIDES} SELECT {K} FROM p WHERE {INSIDE}")
def f9(spark, sf):
    return points(spark, sf).where(f.spatial("polygon", RING)).select(*KEY)


@query("f10_point_in_polygon_left", f"WITH {P}, {SIDES} SELECT {K} FROM p WHERE (SELECT count(*) FROM s WHERE y1 <> y2 AND (y > y1 AND y <= y2 OR y > y2 AND y <= y1) AND x1 + (y - y1) / (y2 - y1) * (x2 - x1) < x) % 2 = 1")
def f10(spark, sf):
    return points(spark, sf).where(g.in_polygon_left(F.col("x"), F.col("y"), RING)).select(*KEY)


@query("f11_polygon_position", f"""WITH {P}, {SIDES}, q AS (SELECT *, EXISTS (SELECT 1 FROM s WHERE abs((y2 - y1) * x - (x2 - x1) * y + x2 * y1 - y2 * x1) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) <= 1.0
 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS near, {INSIDE} AS inside FROM p) SELECT CASE WHEN near THEN 2 WHEN inside THEN 1 ELSE 0 END AS position, count(*) AS n FROM q GROUP BY 1""")
def f11(spark, sf):
    return points(spark, sf).groupBy(g.polygon_position(F.col("x"), F.col("y"), RING).alias("position")).agg(F.count(F.lit(1)).alias("n"))


TILES = "t AS (SELECT CAST(floor(x / 50.0) AS BIGINT) AS tx, CAST(floor(y / 50.0) AS BIGINT) AS ty, count(*) AS n, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM p GROUP BY 1, 2)"


def corner_inside(x, y):
    hit = re.sub(r"\bx\b", x, re.sub(r"\by\b", y, HIT))
    return f"(SELECT count(*) FROM s WHERE {hit}) % 2 = 1"


#: Whether two segments cross, a to b and c to d.
CROSS = "((({2}) - ({0})) * (({5}) - ({1})) - (({3}) - ({1})) * (({4}) - ({0}))) * ((({2}) - ({0})) * (({7}) - ({1})) - (({3}) - ({1})) * (({6}) - ({0}))) < 0 AND ((({6}) - ({4})) * (({1}) - ({5})) - (({7}) - ({5})) * (({0}) - ({4}))) * ((({6}) - ({4})) * (({3}) - ({5})) - (({7}) - ({5})) * (({2}) - ({4}))) < 0"
MEETS = "xmin <= 900 AND xmax >= 100 AND ymin <= 900 AND ymax >= 100 AND (" + " OR ".join(corner_inside(x, y) for x in ("xmin", "xmax") for y in ("ymin", "ymax")) + " OR EXISTS (SELECT 1 FROM s WHERE x1 BETWEEN xmin AND xmax AND y1 BETWEEN ymin AND ymax) OR EXISTS (SELECT 1 FROM s WHERE " + " OR ".join("(" + CROSS.format("x1", "y1", "x2", "y2", *side) + ")" for side in (("xmin", "ymin", "xmax", "ymin"), ("xmax", "ymin", "xmax", "ymax"), ("xmax", "ymax", "xmin", "ymax"), ("xmin", "ymax", "xmin", "ymin"))) + "))"


@query("f12_tiles_that_meet_polygon", f"WITH {P}, {TILES}, {SIDES} SELECT tx, ty, n, xmin, ymin, xmax, ymax FROM t WHERE {MEETS}")
def f12(spark, sf):
    return f.tiles(points(spark, sf), 50.0).where(f.tile_may_meet(RING))


@query("f13_polygon_vertex_in_polygon", f"WITH {P}, {TILES}, {SIDES}, c AS (SELECT tx, ty, unnest([xmin, xmax, xmax, xmin]) AS x, unnest([ymin, ymin, ymax, ymax]) AS y FROM t) SELECT DISTINCT tx, ty FROM c WHERE {INSIDE}")
def f13(spark, sf):
    corners = F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))])
    return f.tiles(points(spark, sf), 50.0).where(F.exists(corners, lambda p: g.in_polygon(p["x"], p["y"], RING))).select("tx", "ty")


@query("f14_circle", f"WITH {P} SELECT {K} FROM p WHERE (x - 500) * (x - 500) + (y - 500) * (y - 500) <= 200.0 * 200.0")
def f14(spark, sf):
    return points(spark, sf).where(f.spatial("circle", (500.0, 500.0, 200.0))).select(*KEY)


@query("f14_box_3d", f"WITH {P} SELECT {K} FROM p WHERE x BETWEEN 100 AND 600 AND y BETWEEN 100 AND 600 AND z BETWEEN 20 AND 60")
def f14_box(spark, sf):
    return points(spark, sf).where(f.spatial("box", (100, 100, 20, 600, 600, 60))).select(*KEY)


@query("f15_polygon_lattice", f"""WITH {P}, {SIDES}, l AS (SELECT x, y FROM (SELECT unnest(range(90, 911))::DOUBLE AS x) CROSS JOIN (SELECT unnest(range(90, 911))::DOUBLE AS y)), m AS (SELECT x, y FROM l WHERE {INSIDE})
SELECT {K} FROM p WHERE EXISTS (SELECT 1 FROM m WHERE m.x = ceil(p.x) AND m.y = ceil(p.y))""")
def f15(spark, sf):
    lattice = spark.range(90, 911).selectExpr("CAST(id AS DOUBLE) AS x").withColumn("y", F.explode(F.transform(F.sequence(F.lit(90), F.lit(910)), lambda v: v.cast("double"))))
    mask = lattice.where(g.in_polygon(F.col("x"), F.col("y"), RING)).select(F.col("x").alias("cx"), F.col("y").alias("cy"))
    p = points(spark, sf).withColumn("cx", F.ceil("x").cast("double")).withColumn("cy", F.ceil("y").cast("double"))
    return p.join(mask, ["cx", "cy"], "left_semi").select(*KEY)


@query("f16_visible", f"WITH {P} SELECT {K} FROM p WHERE display_enable AND seg_type NOT IN (2, 15)")
def f16(spark, sf):
    return f.visible(points(spark, sf), [2, 15]).select(*KEY)


WORD = "(seg_type & 255) | (CASE WHEN cluster_id % 7 = 0 THEN 256 ELSE 0 END) | (CASE WHEN cluster_id % 5 = 0 THEN 512 ELSE 0 END) | (CASE WHEN display_enable THEN 1024 ELSE 0 END)"


@query("f17_property_word", f"WITH {P}, w AS (SELECT *, CAST({WORD} AS INT) AS word FROM p) SELECT word, word & 255 AS seg_type, (word >> 8) & 1 = 1 AS highlight, (word >> 9) & 1 = 1 AS obstacle, CAST(CASE WHEN word & 1024 <> 0 THEN (word & ~255) | 6 ELSE word END AS INT) AS changed, word & ~512 AS cleared, count(*) AS n FROM w GROUP BY ALL")
def f17(spark, sf):
    c = F.col("cluster_id")
    w = points(spark, sf).withColumn("word", prop.pack(F.col("seg_type"), c % 7 == 0, c % 5 == 0, F.col("display_enable")))
    word = F.col("word")
    return w.groupBy("word", prop.segment(word).alias("seg_type"), prop.flag(word, prop.HIGHLIGHT).alias("highlight"), prop.flag(word, prop.OBSTACLE).alias("obstacle"), prop.with_segment(word, 6).alias("changed"), prop.with_flag(word, prop.OBSTACLE, False).alias("cleared")).agg(F.count(F.lit(1)).alias("n"))


@query("f18_default_property", f"WITH {P} SELECT {K}, 1024 AS word, 0 AS cluster FROM p")
def f18(spark, sf):
    return points(spark, sf).select(*KEY, F.lit(prop.DEFAULT).alias("word"), F.lit(0).alias("cluster"))


@query("f21_candidates", f"WITH {P} SELECT {K} FROM p WHERE seg_type = 1 OR z - 2 < 3")
def f21(spark, sf):
    return f.candidates(points(spark, sf).withColumn("hag", F.col("z") - 2), "near_ground").select(*KEY)


@query("f22_write_back", f"""WITH {P}, {SIDES}, n AS (SELECT *, CASE WHEN r % 3 = 0 THEN 15 WHEN r % 3 = 1 THEN 4 ELSE 6 END AS new_type, z > 90 AS outlier, display_enable AND {INSIDE} AS inside FROM p),
m AS (SELECT *, CASE WHEN new_type = 6 THEN 3 WHEN new_type = 15 THEN 2 ELSE new_type END AS target, inside AND outlier AND new_type NOT IN (4, 5) AS noise FROM n)
SELECT {K}, CASE WHEN inside AND NOT noise AND target IN (2, 3) THEN target ELSE seg_type END AS seg_type, display_enable AND NOT noise AS display_enable FROM m""")
def f22(spark, sf):
    p = points(spark, sf).withColumn("new_type", F.when(F.col("r") % 3 == 0, 15).when(F.col("r") % 3 == 1, 4).otherwise(6))
    return f.write_back(p, RING, {6: 3}, F.col("z") > 90, [2, 3]).select(*KEY, "seg_type", "display_enable")


@query("f23_circle_meets_box", f"WITH {P}, {BOXES} SELECT cluster_id FROM b WHERE (500 - greatest(x1, least(500, x2))) * (500 - greatest(x1, least(500, x2))) + (400 - greatest(y1, least(400, y2))) * (400 - greatest(y1, least(400, y2))) <= 2500")
def f23(spark, sf):
    b = points(spark, sf).groupBy("cluster_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    return b.where(g.box_meets_circle([F.col(c) for c in ("x1", "y1", "x2", "y2")], 500.0, 400.0, 50.0)).select("cluster_id")


@query("f24_pruned_polygon_query", f"WITH {P}, {SIDES} SELECT {K} FROM p WHERE {INSIDE}")
def f24(spark, sf):
    """The scan skips row groups beyond the ring's box, by the statistics of the stored column that x comes from; what is left is tested in place, without a join."""
    return points(spark, sf, x_between=(100.0, 900.0)).where(f.spatial("polygon", RING)).select(*KEY)


@query("f25_inside_and_edge_tiles", f"WITH {P}, {SIDES} SELECT {K} FROM p WHERE {INSIDE}")
def f25(spark, sf):
    p = points(spark, sf, x_between=(100.0, 900.0)).withColumn("tx", F.floor(F.col("x") / 50.0)).withColumn("ty", F.floor(F.col("y") / 50.0))
    cover = f.ring_tiles(spark, RING, 50.0).select("tx", "ty", "inside")
    return p.join(cover, ["tx", "ty"]).where(F.col("inside") | f.spatial("polygon", RING)).select(*KEY)


@query("s2_narrow_scan", f"WITH {P} SELECT x, y, z, r, g, b, seg_type AS intensity FROM p")
def s2(spark, sf):
    return points(spark, sf).select("x", "y", "z", "r", "g", "b", F.col("seg_type").alias("intensity"))


@query("s6_class_remap", f"WITH {P}, m AS (SELECT * FROM (VALUES (1, 2), (3, 15), (4, 16)) AS v(f, t)) SELECT coalesce(t, seg_type) AS seg_type, count(*) AS n FROM p LEFT JOIN m ON f = seg_type GROUP BY 1")
def s6(spark, sf):
    from ..operators.joins import remapped

    return remapped(points(spark, sf), {1: 2, 3: 15, 4: 16}).groupBy("seg_type").agg(F.count(F.lit(1)).alias("n"))


@query("s8_scan_date", "SELECT DISTINCT 2000 + l_orderkey % 20 AS y, 1 + l_partkey % 365 AS d, CAST(make_date(2000 + l_orderkey % 20, 1, 1) + CAST(l_partkey % 365 AS INT) AS VARCHAR) AS day FROM lineitem")
def s8(spark, sf):
    from ..sources.las import scan_date

    t = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("2000 + l_orderkey % 20 AS y", "1 + l_partkey % 365 AS d").distinct()
    return t.withColumn("day", scan_date(F.col("y"), F.col("d")).cast("string"))


@query("k4_export_by_type", f"WITH {P} SELECT seg_type, count(*) AS n, min(z) AS zmin, max(z) AS zmax FROM p WHERE display_enable AND seg_type IN (1, 3, 4) GROUP BY seg_type")
def k4(spark, sf):
    """Writes the visible points of the types, a folder each, and reads them back."""
    from ..sources.staging import scratch

    path = scratch(spark, "export")
    f.visible(points(spark, sf)).where(F.col("seg_type").isin(1, 3, 4)).write.partitionBy("seg_type").parquet(path)
    return spark.read.parquet(path).groupBy("seg_type").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("zmin"), F.max("z").alias("zmax"))


@query("s1_las_round_trip", f"WITH {P} SELECT round(x, 4) AS x, y, z, seg_type AS label, r, g, b FROM p")
def s1(spark, sf):
    """Writes the points as LAS files in the shared folder and reads them back."""
    from ..sources import las
    from ..sources.staging import scratch

    path = scratch(spark, "las")
    out = points(spark, sf).select("x", "y", "z", F.col("seg_type").alias("label"), "r", "g", "b")
    las.write_las(out, path)
    return las.read_las(spark, path).select(*[F.round(c, 4).alias(c) for c in "xyz"], "label", "r", "g", "b")
