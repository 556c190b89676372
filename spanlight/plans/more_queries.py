"""Queries of further sinks, selections, mesh and line operators."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import filters as f, raster as r, sampling as s
from ..operators.aggregates import plane_axis
from ..operators.graph import Grid
from ..sources import pcd
from ..sources.points import KEY, P, points
from ..sources.staging import scratch
from .aggregate_queries import TRI
from .filter_queries import K
from .mask_queries import COMPONENTS
from .raster_queries import M, mask
from .registry import query


@query("f19_head", f"WITH {P}, b AS (SELECT cluster_id, min(z) AS z1, max(z) AS z2 FROM p GROUP BY cluster_id) SELECT {K}, z FROM p JOIN b USING (cluster_id) WHERE z > greatest(z1, z2 - 15)")
def f19(spark, sf):
    p = points(spark, sf)
    ends = p.groupBy("cluster_id").agg(F.min("z").alias("z1"), F.max("z").alias("z2"))
    return f.head(p.join(ends, "cluster_id"), 15.0, F.col("z1"), F.col("z2")).select(*KEY, "z")


@query("k3_pcd_round_trip", f"WITH {P} SELECT x, y, z FROM p")
def k3(spark, sf):
    path = scratch(spark, "pcd")
    pcd.write_pcd(points(spark, sf), path)
    return pcd.read_pcd(spark, path)


def _split_sql(most, levels):
    parts, last = ["n0 AS (SELECT x, y, z, CAST(floor(x / 500.0) AS BIGINT) || '_' || CAST(floor(y / 500.0) AS BIGINT) || ':' AS node FROM p)"], "n0"
    for i in range(levels):
        parts.append(f"b{i} AS (SELECT node, count(*) AS n, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, min(z) AS z1, max(z) AS z2 FROM {last} GROUP BY node), n{i + 1} AS (SELECT x, y, z, node || CASE WHEN n <= {most} OR greatest(x2 - x1, y2 - y1, z2 - z1) = 0 THEN '' WHEN x2 - x1 = greatest(x2 - x1, y2 - y1, z2 - z1) THEN CASE WHEN x >= (x1 + x2) / 2 THEN '1' ELSE '0' END WHEN y2 - y1 = greatest(x2 - x1, y2 - y1, z2 - z1) THEN CASE WHEN y >= (y1 + y2) / 2 THEN '1' ELSE '0' END ELSE CASE WHEN z >= (z1 + z2) / 2 THEN '1' ELSE '0' END END AS node FROM {last} JOIN b{i} USING (node))")
        last = f"n{i + 1}"
    return f"WITH {P}, {', '.join(parts)} SELECT node, count(*) AS n, min(x) AS x1, max(x) AS x2 FROM {last} GROUP BY node"


@query("k5_split_nodes", _split_sql(2000, 7))
def k5(spark, sf):
    """Tiles split into halves until nodes are small, written a folder a node's tile and read back."""
    path = scratch(spark, "nodes")
    s.split_nodes(points(spark, sf).select("x", "y", "z"), 500.0, 2000, 7).withColumn("tile", F.substring_index("node", ":", 1)).write.partitionBy("tile").parquet(path)
    return spark.read.parquet(path).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x1"), F.max("x").alias("x2"))


@query("t8_sequential_sample", f"WITH {P} SELECT {K} FROM p ORDER BY md5('11' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), {K} LIMIT 700")
def t8(spark, sf):
    return s.sequential_sample(points(spark, sf), 700, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 11).select(*KEY)


@query("t11_chains")
def t11(spark, sf):
    """Suppliers of a nation as towers of a line; tested against a plain chain."""
    t = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_nationkey AS line", "s_suppkey AS tower", "s_acctbal / 100.0D AS x", "CAST(s_suppkey % 37 AS DOUBLE) AS y")
    return s.chains(t, "line", "tower", 40.0)


@query("g11_normals", f"WITH {TRI}, n AS (SELECT vec_id, ay * bz - az * by_ AS nx, az * bx - ax * bz AS ny, ax * by_ - ay * bx AS nz FROM t) SELECT vec_id, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) AS nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 6) AS ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) AS nz FROM n WHERE nx * nx + ny * ny + nz * nz > 0")
def g11(spark, sf):
    v = [F.col("embedding")[i].cast("double") for i in range(6)]
    n = g.triangle_normal([F.lit(0.0)] * 3, v[:3], v[3:])
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", *[F.round(c, 6).alias(k) for c, k in zip(n, ("nx", "ny", "nz"))]).where("nx IS NOT NULL")


@query("g11_clipped_area", f"""WITH {TRI}, h AS (SELECT vec_id, sqrt((ay*bz-az*by_)**2 + (az*bx-ax*bz)**2 + (ax*by_-ay*bx)**2) / 2 AS area, 0.05 AS h1, az + 0.05 AS h2, bz + 0.05 AS h3 FROM t),
 c AS (SELECT vec_id, area, CASE WHEN h1 > 0 AND h2 > 0 AND h3 > 0 THEN 1 WHEN h2 <= 0 AND h3 <= 0 THEN h1 / (h1 - h2) * h1 / (h1 - h3) WHEN h2 <= 0 THEN 1 - h2 / (h2 - h1) * h2 / (h2 - h3) WHEN h3 <= 0 THEN 1 - h3 / (h3 - h1) * h3 / (h3 - h2) END AS share FROM h) SELECT vec_id, round(area * share, 8) AS area FROM c""")
def g11_clip(spark, sf):
    """Area of triangles above the plane z = -0.05."""
    v = [F.col("embedding")[i].cast("double") for i in range(6)]
    corners = ([F.lit(0.0)] * 3, v[:3], v[3:])
    share = g.share_above(*[c[2] + 0.05 for c in corners])
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.round(s.triangle_area(*corners) * share, 8).alias("area"))


TURN = "atan2(2 * covar_pop(k.x, k.y), covar_pop(k.x, k.x) - covar_pop(k.y, k.y)) / 2"


@query("r6_component_lines", f"WITH RECURSIVE {P}, {M.format('seg_type = 4').replace('20.0', '4.0')}, {COMPONENTS.format('m')} SELECT CAST(min(k.x) AS BIGINT) AS cx, CAST(min(k.y) AS BIGINT) AS cy, count(*) AS cells, round(cos({TURN}) * cos({TURN}), 5) + 0.0 AS xx, round(cos({TURN}) * sin({TURN}), 5) + 0.0 AS xy FROM l JOIN k USING (id) GROUP BY component HAVING count(*) BETWEEN 5 AND 400")
def r6(spark, sf):
    """The main direction of each piece of a mask, in place of a line detector on pixels; as products, which have no sign of their own."""
    cells = points(spark, sf).where("seg_type = 4").select(F.floor(F.col("x") / 4.0).alias("cx"), F.floor(F.col("y") / 4.0).alias("cy")).distinct()
    l = r.labelled(cells).select("component", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"))
    n = l.groupBy("component").agg(F.count(F.lit(1)).alias("cells"), F.min("x").cast("long").alias("cx"), F.min("y").cast("long").alias("cy")).where("cells BETWEEN 5 AND 400")
    both = n.join(plane_axis(l, "component"), "component")
    return both.select("cx", "cy", "cells", (F.round(F.col("ux") * F.col("ux"), 5) + 0.0).alias("xx"), (F.round(F.col("ux") * F.col("uy"), 5) + 0.0).alias("xy"))


@query("p3c_pole_layers", f"WITH {P}, c AS (SELECT cluster_id, CAST(floor(z / 10.0) AS BIGINT) AS layer, count(DISTINCT (floor(x / 25.0), floor(y / 25.0))) * 625.0 AS area, max(z) - min(z) AS height FROM p WHERE seg_type = 3 GROUP BY 1, 2) SELECT cluster_id, layer, area, height FROM c WHERE area < 10000 AND height > 0.6 * 10")
def p3c(spark, sf):
    """Layers of a trunk: narrow, and filled over most of their height."""
    from ..operators.aggregates import pole_layers

    return pole_layers(points(spark, sf).where("seg_type = 3"), "cluster_id", 10.0, 25.0, 10_000.0, 0.6)


@query("p19_trees_in_box")
def p19(spark, sf):
    """Trees of a box: seeds on high cells grow to crowns, trees of a size are numbered anew and measured. Crowns are tested against a plain version."""
    from ..operators import classify as c, windows as w

    p = points(spark, sf).where("seg_type IN (2, 15) AND x BETWEEN 100 AND 600 AND y BETWEEN 100 AND 600")
    tops = s.cell_tops(p, 10.0, KEY)
    tops = tops.withColumn("id", Grid.of(tops, ("cx", "cy")).id())
    seeds = w.local_maxima(tops.select("id", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), "z"), F.lit(2.0), 2.0, "id").select("id", F.lit(True).alias("is_seed"))
    seeded = tops.join(seeds, "id", "left").withColumn("seed", F.when(F.col("is_seed"), F.col("id") + 1).otherwise(0))
    crowns = c.crowns(seeded.select("cx", "cy", "z", "seed"), 10.0, 0.45, 0.55, 4).where("tree <> 0")
    m = crowns.join(tops.select("cx", "cy", "z"), ["cx", "cy"]).groupBy("tree").agg(F.count(F.lit(1)).alias("cells"), F.max("z").alias("top_z")).where("cells >= 2")
    return w.numbered(m, [F.col("tree")], "number").select("number", "cells", "top_z")


@query("p20_tile_stream", f"WITH {P} SELECT CAST(floor(x / 125.0) AS BIGINT) AS tx, CAST(floor(y / 125.0) AS BIGINT) AS ty, count(*) AS n, min(z) AS z1, max(z) AS z2 FROM p GROUP BY 1, 2")
def p20(spark, sf):
    """The table as a stream, appended to tiles of all levels, and read back by place."""
    from ..sources.points import streamed
    from ..streaming import tiles

    path = scratch(spark, "stream")
    tiles.append_tiles(streamed(spark, sf).select("x", "y", "z"), f"{path}/tiles", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/tiles").groupBy(F.floor(F.col("x") / 125.0).alias("tx"), F.floor(F.col("y") / 125.0).alias("ty")).agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("z1"), F.max("z").alias("z2"))


@query("s6_imported_classes", f"WITH {P}, m AS (SELECT * FROM (VALUES (1, 2), (3, 15), (4, 16)) AS v(f, t)) SELECT CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_partkey % 16 AS INT) ELSE coalesce(t, seg_type) END AS seg_type, count(*) AS n FROM p LEFT JOIN m ON f = seg_type GROUP BY 1")
def s6_imported(spark, sf):
    from ..operators.joins import imported_classes

    p = points(spark, sf).withColumn("software", F.when(F.col("l_suppkey") % 3 == 0, "scanner 1.2").otherwise("other")).withColumn("user_data", F.expr("CAST(l_partkey % 16 AS INT)"))
    return imported_classes(p, "scanner", {1: 2, 3: 15, 4: 16}).groupBy("seg_type").agg(F.count(F.lit(1)).alias("n"))


@query("t3_ranked_models", f"WITH {P}, d AS (SELECT cluster_id, max(x) - min(x) AS dx, max(y) - min(y) AS dy, max(z) - min(z) AS dz FROM p GROUP BY cluster_id), m AS (SELECT * FROM (VALUES (1, 900.0, 900.0, 98.0), (2, 800.0, 950.0, 96.0), (3, 950.0, 990.0, 98.0)) AS v(model, mx, my, mz)), r AS (SELECT cluster_id, model, (dx-mx)*(dx-mx)+(dy-my)*(dy-my)+(dz-mz)*(dz-mz) AS rms FROM d CROSS JOIN m) SELECT cluster_id, model, row_number() OVER (PARTITION BY cluster_id ORDER BY rms, model) AS rank FROM r WHERE rms < 30000")
def t3(spark, sf):
    """Models of a small library (a literal array), ranked by their distance to each cluster's box, below a threshold."""
    boxes = points(spark, sf).groupBy("cluster_id").agg(*[(F.max(c) - F.min(c)).alias(f"d{c}") for c in "xyz"])
    library = [(1, 900.0, 900.0, 98.0), (2, 800.0, 950.0, 96.0), (3, 950.0, 990.0, 98.0)]
    scored = [F.struct(sum(((F.col(f"d{c}") - m) * (F.col(f"d{c}") - m) for c, m in zip("xyz", box)), F.lit(0.0)).alias("rms"), F.lit(model).alias("model")) for model, *box in library]
    ranked = F.array_sort(F.filter(F.array(*scored), lambda s: s["rms"] < 30_000))
    return boxes.select("cluster_id", F.posexplode(ranked).alias("rank", "m")).select("cluster_id", "m.model", (F.col("rank") + 1).cast("long").alias("rank"))


@query("x6_codes_of_descriptions", "SELECT s_suppkey, CAST(CASE s_suppkey % 3 WHEN 0 THEN 4326 WHEN 1 THEN 32631 ELSE 28992 END AS INT) AS code FROM supplier")
def x6_text(spark, sf):
    from ..functions import crs

    texts = F.array(*[F.lit(crs.well_known_text(code)) for code in (4326, 32631, 28992)])
    t = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", F.element_at(texts, (F.col("s_suppkey") % 3 + 1).cast("int")).alias("text"))
    return t.select("s_suppkey", crs.code_of_text(F.col("text")).alias("code"))


@query("p3e_local_linearity", f"""WITH {P}, o AS (SELECT unnest([-1, 0, 1]) AS d), v AS (SELECT DISTINCT CAST(floor(x / 40.0) AS BIGINT) AS vx, CAST(floor(y / 40.0) AS BIGINT) AS vy, CAST(floor(z / 40.0) AS BIGINT) AS vz FROM p WHERE seg_type = 4), q AS (SELECT x, y, z, CAST(floor(x / 40.0) AS BIGINT) + i.d AS vx, CAST(floor(y / 40.0) AS BIGINT) + j.d AS vy, CAST(floor(z / 40.0) AS BIGINT) + k.d AS vz FROM p, o i, o j, o k WHERE seg_type = 4),
 m AS (SELECT vx, vy, vz, count(*) AS n, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM q JOIN v USING (vx, vy, vz) GROUP BY 1, 2, 3 HAVING count(*) >= 10), u AS (SELECT *, (a + b + c) / 3 AS q FROM m),
 s AS (SELECT *, sqrt(((a - q)**2 + (b - q)**2 + (c - q)**2 + 2 * (d * d + e * e + f * f)) / 6) AS s FROM u), t AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / s**3 / 2))) / 3 AS t FROM s),
 l AS (SELECT vx, vy, vz, n, q + 2 * s * cos(t) AS l1, q + 2 * s * cos(t - 2 * pi() / 3) AS l2 FROM t) SELECT vx, vy, vz, n, round((l1 - l2) / l1, 5) AS linearity FROM l""")
def p3e(spark, sf):
    from ..operators.corridor import local_linearity

    l = local_linearity(points(spark, sf).where("seg_type = 4"), 40.0).where("n >= 10")
    return l.withColumn("linearity", F.round("linearity", 5))
