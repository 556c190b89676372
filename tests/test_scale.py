"""What grows with the data: few edges of dense grids, few candidates of dense clouds, bounded batches."""

import itertools
import math
import random
import time

from pyspark.sql import functions as F

from spanlight.operators import graph, joins as j, sampling as s


def test_dense_grids_send_few_edges_into_rounds(spark, monkeypatch):
    seen, plain = [], graph.stars

    def stars(edges, write, drop):
        seen.append(edges.where("u <> v").distinct().count())
        return plain(edges, write, drop)

    monkeypatch.setattr(graph, "stars", stars)
    n = 40
    cells = spark.range(n**3).select((F.col("id") % n).alias("x"), (F.expr(f"id div {n}") % n).alias("y"), F.expr(f"id div {n * n}").alias("z"))
    df = cells.where("x <> 35").select(*[(F.col(c) + 0.5).alias(c) for c in "xyz"])
    out = graph.voxel_components(df, 1.0)
    assert sorted(r["count"] for r in out.groupBy("component").count().collect()) == [4 * n * n, 35 * n * n]
    assert seen[0] < 100


def test_components_over_blocks(spark):
    r_ = random.Random(8)
    places = {(r_.randrange(70), r_.randrange(70), r_.randrange(70)) for _ in range(34_000)}
    df = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in places], "x double, y double, z double").withColumn("x", F.col("x") - 40)
    root = {p: p for p in places}

    def find(p):
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    for p in places:
        for d in itertools.product((-1, 0, 1), repeat=3):
            q = tuple(a + b for a, b in zip(p, d))
            if q in root:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    want = {}
    for p in places:
        want.setdefault(find(p), set()).add(p)
    grid = graph.Grid.of_points(df, 1.0)
    got = {}
    for r in graph.voxel_components(df, 1.0, grid=grid).select("x", "y", "z", F.struct(*grid.cell(F.col("component"), "a", "b", "c")).alias("c")).collect():
        got.setdefault((r["c"]["a"] + 40, r["c"]["b"], r["c"]["c"]), set()).add((r["x"] + 40, r["y"], r["z"]))
    assert got == want
    kept = graph.voxel_clusters(df, 1.0, 2, 5, True, grid=grid).count()
    assert kept == sum(len(v) for v in want.values() if 2 <= len(v) <= 5) > 0


def test_nearest_of_a_dense_cloud_with_copies(spark):
    r_ = random.Random(5)
    rows = [(r_.gauss(0, 0.01), r_.gauss(0, 0.01), 0.0) for _ in range(1500)] + [(3.0, 3.0, 0.0)] * 1500 + [(50.0, 0.0, 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "id long, x double, y double, z double")
    assert j.crowded_radius(df, "xyz", 1.0, 200.0, 2.0) < 0.01
    got = {}
    for r in j.nearest(df, df, 3, "id", "id", skip_self=True).collect():
        got.setdefault(r["a"], []).append((r["rank"], r["b"], r["d2"]))
    assert len(got) == len(rows)
    for i in [*range(0, 1500, 100), 1500, 1501, 1504, 2999, 3000]:
        order = sorted((sum((u - v) ** 2 for u, v in zip(rows[i], q)), k) for k, q in enumerate(rows) if k != i)[:3]
        assert sorted(got[i]) == [(n + 1, k, d) for n, (d, k) in enumerate(order)]


def test_half_a_cent_goes_up_in_boxes_by_corner(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rows = [(k, 7, k, 1, 5.0, price, 0.0, 0.0, "A", "F") for k, price in enumerate((999.5, 100.5, 267.5, 1428.5, 90011.5))]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in entry.queries()["f8_boxes_by_rounded_corner"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(con.sql(entry.oracle_sql()["f8_boxes_by_rounded_corner"]).fetchall())
    assert [r[0] for r in got] == [1.01, 2.68, 10.0, 14.29, 900.12]


def test_chains_of_many_rows_against_plain_search(spark):
    r_ = random.Random(3)
    at = [(r_.randrange(60) / 2, r_.randrange(40) / 2) for _ in range(120)] + [(500.0, 0.0)] + [(r_.uniform(60, 62), 1.0) for _ in range(20)]
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(at)], "line int, id long, x double, y double")
    out, open_ = [0], set(range(1, len(at)))
    for end in (-1, 0):
        while open_:
            d, i = min(((at[i][0] - at[out[end]][0]) ** 2 + (at[i][1] - at[out[end]][1]) ** 2, i) for i in open_)
            if d > 16:
                break
            open_.remove(i)
            out.insert(len(out) if end else 0, i)
    assert [r["id"] for r in s.chains(df, "line", "id", 4.0).orderBy("place").collect()] == out
    many = spark.range(20_000).select(F.lit(1).alias("line"), "id", (F.col("id") * 7919 % 1009).cast("double").alias("x"), (F.col("id") * 31 % 499).cast("double").alias("y"))
    began = time.time()
    assert s.chains(many, "line", "id", 2000.0).count() == 20_000
    assert time.time() - began < 60


def test_las_blocks_are_stored_by_the_task_that_makes_them(spark, tmp_path, monkeypatch):
    from spanlight.sources import las

    monkeypatch.setattr(las, "BLOCK", 1000)
    monkeypatch.setattr(type(spark.range(0)), "foreachPartition", lambda *_: 1 / 0)  # whole files as rows of another Python stage
    df = spark.range(0, 25_000, 1, 2).select(*[(F.col("id") % m).cast("double").alias(c) for c, m in (("x", 100), ("y", 70), ("z", 30))], *[F.lit(1).alias(c) for c in ("label", "r", "g", "b")])
    las.write_las(df, f"{tmp_path}/las")
    found = las.headers(spark, f"{tmp_path}/las").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files")).first()
    assert found["n"] == 25_000 and found["files"] >= 2


def test_dense_points_send_few_pairs_into_rounds(spark, monkeypatch):
    seen, plain = [], graph.stars

    def stars(edges, write, drop):
        seen.append(edges.count())
        return plain(edges, write, drop)

    monkeypatch.setattr(graph, "stars", stars)
    r_ = random.Random(6)
    at = [(r_.gauss(0, 0.3), r_.gauss(0, 0.3)) for _ in range(1500)] + [(r_.uniform(0, 60), r_.uniform(0, 60)) for _ in range(700)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)] + [(5000, None, 1.0)], "id long, x double, y double")
    root = list(range(len(at)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, p in enumerate(at):
        for k in range(i):
            if (p[0] - at[k][0]) ** 2 + (p[1] - at[k][1]) ** 2 <= 1.5 * 1.5:
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in graph.euclidean_components(df, "id", 1.5, "xy").collect()}
    assert got == {i: find(i) for i in range(len(at))} | {5000: 5000}
    assert sum(seen) < 10_000


def test_union_leaves_out_cells_that_a_polygon_holds(spark):
    from spanlight.operators import polygons
    from spanlight.sources.staging import scratch, written

    r_ = random.Random(4)
    boxes = [(i, r_.uniform(0, 10), r_.uniform(0, 10), r_.uniform(4, 6)) for i in range(150)]
    ring = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    df = spark.createDataFrame([(i, ring(x, y, s)) for i, x, y, s in boxes], "id long, ring array<struct<x: double, y: double>>")
    base = scratch(spark, "test")
    sides = written(polygons.sides(df).withColumn("side", F.monotonically_increasing_id()), base, "sides")
    live = polygons.live_cells(df, sides, base)
    assert polygons.pieces(sides, live).count() < 1500  # all cuts of all sides are above ten thousand
    n = 400
    hit = sum(any(x < u < x + s and y < v < y + s for _, x, y, s in boxes) for u in ((i + 0.5) * 16 / n for i in range(n)) for v in ((k + 0.5) * 16 / n for k in range(n)))
    area = polygons.ring_areas(polygons.union(df)).agg(F.sum("area")).first()[0]
    assert abs(area - hit * (16 / n) ** 2) < 1.0


def test_points_meet_small_rasters_without_a_shuffle(spark):
    from spanlight.operators import classify, corridor
    from spanlight.sources.files import Options

    r_ = random.Random(2)
    rows = [(i, r_.uniform(0, 99), r_.uniform(0, 99), r_.uniform(0, 60), r_.choice([1, 2, 15]), True) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, seg_type int, display_enable boolean")
    shuffles = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    out = corridor.segmented(df, "id", Options.read("[Options]\nkinds = ground, vegetation\n"), [(0, 0), (99, 0), (99, 99), (0, 99)], [1, 2, 3])
    assert shuffles(out) == shuffles(classify.ground_limits(df)) == shuffles(classify.normalised(df)) == 0
    assert out.count() == 900
