"""Queries of file sources and sinks: what a table gives is written in a format and read back."""

from pyspark.sql import functions as F

from ..operators import sampling as s
from ..sources import files, las, layout
from ..sources.points import KEY, P, points
from ..sources.staging import scratch
from .filter_queries import INSIDE, K, RING, SIDES
from .registry import query

TILE = "CAST(floor(x / 125.0) AS BIGINT) AS tx, CAST(floor(y / 125.0) AS BIGINT) AS ty"


def las_copy(spark, sf):
    path = scratch(spark, "las")
    las.write_las(points(spark, sf).select("x", "y", "z", F.col("seg_type").alias("label"), "r", "g", "b"), path)
    return path


@query("s3_header_counts", "SELECT count(*) AS n FROM lineitem")
def s3(spark, sf):
    return las.headers(spark, las_copy(spark, sf)).agg(F.sum("n").alias("n"))


@query("s4_voxel_scan", f"WITH {P} SELECT round(avg(x) + 0.0000137, 3) AS x, round(avg(y) + 0.0000137, 3) AS y, round(avg(z) + 0.0000137, 3) AS z FROM p GROUP BY floor(x / 50.0), floor(y / 50.0), floor(z / 50.0)")
def s4(spark, sf):
    return las.read_points(spark, las_copy(spark, sf), 50.0).select(*[F.round(F.col(c) + 0.0000137, 3).alias(c) for c in "xyz"])


@query("s7_class_map", f"WITH {P}, m AS (SELECT CAST(ps AS INT) AS seg_type, min(target) AS target FROM (SELECT p_size % 16 AS ps, CAST(p_partkey % 20 AS INT) AS target FROM part) GROUP BY 1) SELECT coalesce(target, seg_type) AS seg_type, count(*) AS n FROM p LEFT JOIN m USING (seg_type) GROUP BY 1")
def s7(spark, sf):
    path = scratch(spark, "classes")
    files.write_xml(spark.read.parquet(f"{sf}/part.parquet").selectExpr("CAST(p_size % 16 AS INT) AS _Type", "CAST(p_partkey % 20 AS INT) AS _To"), path, "Map", "Item")
    return points(spark, sf).join(files.class_map(spark, path), "seg_type", "left").groupBy(F.coalesce("target", "seg_type").alias("seg_type")).agg(F.count(F.lit(1)).alias("n"))


@query("s11_project_tree", f"WITH {P} SELECT {TILE}, 0 AS level, 'tile_' || CAST(floor(x / 125.0) AS BIGINT) || '_' || CAST(floor(y / 125.0) AS BIGINT) AS file, count(*) AS n FROM p GROUP BY 1, 2, 4")
def s11(spark, sf):
    """The tree of tiles as an XML project, and back (the project's sink and source)."""
    path = scratch(spark, "project")
    t = points(spark, sf).groupBy(F.floor(F.col("x") / 125.0).alias("_tx"), F.floor(F.col("y") / 125.0).alias("_ty")).agg(F.count(F.lit(1)).alias("_n"))
    files.write_xml(t.withColumn("_level", F.lit(0)).withColumn("_file", F.concat(F.lit("tile_"), "_tx", F.lit("_"), "_ty")), path, "Project", "Node")
    return files.project_tiles(spark, path)


@query("s12_cluster_catalogue", f"WITH {P} SELECT DISTINCT cluster_id, CAST(cluster_id % 7 AS INT) AS kind, CAST(floor(x / 125.0) AS BIGINT) || '_' || CAST(floor(y / 125.0) AS BIGINT) AS tile FROM p")
def s12(spark, sf):
    path = scratch(spark, "clusters")
    tile = F.concat_ws("_", F.floor(F.col("x") / 125.0), F.floor(F.col("y") / 125.0)).alias("tile")
    c = points(spark, sf).select("cluster_id", tile).distinct().groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_list("tile")), ";").alias("_VALUE"))
    files.write_xml(c.select(F.col("cluster_id").alias("_Id"), F.expr("CAST(cluster_id % 7 AS INT)").alias("_ClassifyType"), "_VALUE"), path, "Clusters", "Cluster")
    return files.cluster_catalogue(spark, path)


@query("s13_roads", "WITH v AS (SELECT o_custkey AS id, o_totalprice / 1000 AS x, CAST(o_orderkey % 997 AS DOUBLE) AS y FROM orders), n AS (SELECT id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY id ORDER BY x, y)) SELECT id, x1, y1, x2, y2 FROM n WHERE x2 IS NOT NULL")
def s13(spark, sf):
    """Roads of customers' orders, written as text geometry (the road sink) and read back as segments."""
    path = scratch(spark, "roads")
    v = F.array_sort(F.collect_list(F.struct((F.col("o_totalprice") / 1000).alias("x"), (F.col("o_orderkey") % 997).cast("double").alias("y")))).alias("vertices")
    files.write_roads(spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(v), path)
    return files.road_segments(files.read_roads(spark, path))


@query("s17_tile_paths", f"WITH {P} SELECT CAST(floor(x / 250.0) AS INT) AS tx, CAST(floor(y / 250.0) AS INT) AS ty, 'tx=' || CAST(floor(x / 250.0) AS INT) || '/ty=' || CAST(floor(y / 250.0) AS INT) AS folder, count(*) AS n FROM p GROUP BY 1, 2, 3")
def s17(spark, sf):
    path = scratch(spark, "tiles")
    files.write_tiles(points(spark, sf).select("x", "y", "z"), path, 250.0)
    return files.tile_paths(spark, path)


@query("k11_tree_table", f"WITH {P} SELECT cluster_id, max(z) AS top_z, round(sqrt((max(x) - min(x))**2 + (max(y) - min(y))**2), 6) AS crown_size, count(DISTINCT (floor(x / 0.5), floor(y / 0.5))) * 0.25 AS crown_area FROM p WHERE seg_type IN (2, 15) GROUP BY cluster_id")
def k11(spark, sf):
    from ..operators.aggregates import tree_metrics

    path = scratch(spark, "trees")
    m = tree_metrics(points(spark, sf).where("seg_type IN (2, 15)").withColumn("hag", F.col("z")), "cluster_id")
    files.write_table(m.select("cluster_id", "top_z", F.round("crown_size", 6).alias("crown_size"), "crown_area"), path)
    return files.read_table(spark, path, "cluster_id int, top_z double, crown_size double, crown_area double")


@query("k7_pyramid", f"""WITH {P}, h AS (SELECT CAST(floor(x / 125.0) AS BIGINT) AS tx, CAST(floor(y / 125.0) AS BIGINT) AS ty, md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || CAST(l_extendedprice * 100 AS BIGINT)) AS h FROM p),
 l1 AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY h) AS i FROM h WINDOW w AS (PARTITION BY tx // 2, ty // 2)), k1 AS (SELECT * FROM l1 WHERE n <= 10 OR i <= floor(n * 0.25)),
 l2 AS (SELECT tx, ty, h, count(*) OVER w AS n, row_number() OVER (w ORDER BY h) AS i FROM k1 WINDOW w AS (PARTITION BY tx // 4, ty // 4)), k2 AS (SELECT * FROM l2 WHERE n <= 10 OR i <= floor(n * 0.25))
 SELECT 0 AS level, tx AS px, ty AS py, count(*) AS n, min(h) AS first FROM h GROUP BY 2, 3 UNION ALL SELECT 1, tx // 2, ty // 2, count(*), min(h) FROM k1 GROUP BY 2, 3 UNION ALL SELECT 2, tx // 4, ty // 4, count(*), min(h) FROM k2 GROUP BY 2, 3""")
def k7(spark, sf):
    key = F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).cast("binary"))
    h = points(spark, sf).select(F.floor(F.col("x") / 125.0).alias("px"), F.floor(F.col("y") / 125.0).alias("py"), key.alias("h"))
    return s.pyramid(h, "h", 3, 0.25, 10).groupBy("level", "px", "py").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first"))


@query("f24_stored_layout", f"WITH {P}, {SIDES} SELECT {K} FROM p WHERE {INSIDE}")
def f24_stored(spark, sf):
    """The points stored along a curve and read back for a polygon: files by their boxes, row groups by their bounds."""
    path = scratch(spark, "layout")
    layout.write_layout(points(spark, sf), path, file_points=max(1000, spark.read.parquet(f"{sf}/lineitem.parquet").count() // 64), group_bytes=1 << 18)
    return layout.read_layout(spark, path, RING).select(*KEY)


@query("s3_record_ranges", "SELECT count(*) AS n, count(*) * 26 AS bytes FROM lineitem")
def s3_ranges(spark, sf):
    """The ranges of records that a scan of the points' files would read."""
    return las.ranges(spark, las_copy(spark, sf), size=1000).agg(F.sum("count").alias("n"), F.sum("bytes").alias("bytes"))
