import math
import random

import pytest
from pyspark.sql import functions as F

from spanlight.functions import geometry as g, properties as prop
from spanlight.operators import aggregates as a, classify as c, filters as f, graph, joins as j, raster as r, sampling as s, windows as w
from spanlight.sources import las


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], "id long, x double, y double, z double")


def test_rays_at_edges_and_vertices(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    at = [(5, 5), (0, 5), (10, 5), (5, 0), (5, 10), (0, 0), (10, 10), (0, 10), (10, 0), (-1, 5), (11, 5), (5, 11)]
    df = cloud(spark, [(*p, 0) for p in at]).select("id", g.in_polygon(F.col("x"), F.col("y"), square).alias("a"), g.in_polygon_left(F.col("x"), F.col("y"), square).alias("b"), g.polygon_position(F.col("x"), F.col("y"), square, 0.5).alias("p")).orderBy("id").collect()
    assert [x["a"] for x in df] == [True, True, False, True, False, True, False, False, False, False, False, False]
    assert [x["b"] for x in df] == [True, False, True, False, True, False, True, False, False, False, False, False]
    assert [x["p"] for x in df] == [1, 2, 2, 2, 2, 2, 2, 2, 2, 0, 0, 0]


def test_ring_columns_follow_ring_lists(spark):
    ring = [(0.0, 0.0), (8.0, 1.0), (5.0, 9.0)]
    column = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])
    df = cloud(spark, [(random.Random(i).uniform(-1, 9), random.Random(-i - 1).uniform(-1, 10), 0) for i in range(200)])
    assert df.where(g.in_polygon(F.col("x"), F.col("y"), ring) != g.in_polygon(F.col("x"), F.col("y"), column)).count() == 0
    assert df.limit(1).select(g.polygon_area(column).alias("a")).first()["a"] == pytest.approx(g.ring_area(ring))


def test_two_blobs_are_two_components(spark):
    r_ = random.Random(1)
    rows = [(r_.gauss(0, 1), r_.gauss(0, 1), r_.gauss(0, 1)) for _ in range(100)] + [(r_.gauss(20, 1), r_.gauss(0, 1), r_.gauss(0, 1)) for _ in range(100)]
    df = cloud(spark, rows)
    found = graph.euclidean_components(df, "id", 2.5).groupBy("component").count().collect()
    assert sum(x["count"] for x in found) == 200 and len([x for x in found if x["count"] > 90]) == 2
    sizes = sorted(x["count"] for x in graph.voxel_components(df, 2.5).groupBy("component").count().collect())
    assert sizes[-2:] == [100, 100] or sum(sizes) == 200


def test_component_sizes_at_the_limits(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(2, 2)] * 5, "id long, component long")
    assert graph.sized(df, 3, 5, True).count() == 8 and graph.sized(df, 3, 5, False).count() == 3


def test_long_path_is_one_component(spark):
    edges = spark.range(0, 300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    out = graph.components(spark.range(0, 302).select("id"), edges)
    assert sorted(x["component"] for x in out.collect()) == [0] * 301 + [301]


def test_nearest_against_brute_force(spark):
    r_ = random.Random(4)
    rows = [(r_.uniform(0, 10), r_.uniform(0, 10), r_.uniform(0, 1)) for _ in range(60)] + [(90, 90, 90)]
    df = cloud(spark, rows)
    got = {(x["a"], x["rank"]): x["b"] for x in j.nearest(df, df, 3, "id", "id", start=0.5, skip_self=True).collect()}
    for i, p in enumerate(rows):
        order = sorted((math.dist(p, q) ** 2, k) for k, q in enumerate(rows) if k != i)
        assert [got[i, n + 1] for n in range(3)] == [k for _, k in order[:3]]


def test_outlier_of_a_grid(spark):
    df = cloud(spark, [(x, y, 0) for x in range(10) for y in range(10)] + [(50, 50, 0)])
    assert [x["id"] for x in graph.denoise_statistical(df, "id", 4, 3.0, 1.0).where("outlier").collect()] == [100]


def test_robust_extremes_ignore_tails(spark):
    rows = [0.5] * 2 + [v for v in (3.5, 4.5, 5.5) for _ in range(30)] + [8.5]
    out = a.robust_extremes(cloud(spark, [(v, 0, 0) for v in rows]), "x", 1.0, 3).first()
    assert (out["low"], out["high"]) == (3.5, 5.5)
    assert a.robust_extremes(cloud(spark, [(1, 0, 0)]), "x", 1.0, 3).count() == 0


def test_curves_are_recovered(spark):
    rows = [(0, y / 10, 0.01 * (y / 10) ** 2 - 0.3 * y / 10 + 7) for y in range(200)]
    fit = a.parabola_fit(cloud(spark, rows)).first()
    assert [fit[k] for k in "abc"] == pytest.approx([0.01, -0.3, 7], abs=1e-6)
    noisy = cloud(spark, rows + [(0, 5, 40)] * 5).withColumn("wire", F.lit(1))
    fit = a.robust_parabola(noisy, "wire").first()
    assert [fit[k] for k in "abc"] == pytest.approx([0.01, -0.3, 7], abs=1e-2)


def test_line_is_linear(spark):
    e = a.shape_features(a.eigenvalues(a.covariance(cloud(spark, [(i, 2 * i, 3 * i) for i in range(50)])))).first()
    assert e["linearity"] == pytest.approx(1, abs=1e-6) and e["sphericity"] == pytest.approx(0, abs=1e-6)


def test_ground_keeps_plane_drops_spikes(spark):
    plane = [(x, y, 0.01 * x) for x in range(0, 60, 2) for y in range(0, 60, 2)]
    out = c.ground(cloud(spark, plane + [(11, 11, 9), (31, 31, 12), (45, 7, 15)]), 2.0).select("id").collect()
    ids = {x["id"] for x in out}
    assert len(ids) == len(plane) and not ids & {len(plane), len(plane) + 1, len(plane) + 2}


def test_raster_borders(spark):
    five = spark.createDataFrame([(x, y, float(9 if (x, y) == (0, 0) else 1)) for x in range(5) for y in range(5)], "cx long, cy long, value double")
    top = {(x["cx"], x["cy"]): x["value"] for x in w.stencil(five, 1, "max").collect()}
    assert top[0, 0] == top[1, 1] == 9 and top[2, 2] == 1
    assert r.eroded(five, 3).count() == 9 and r.dilated(five, 3).count() == 49 and r.closed(five, 3).count() == 25
    clamped = w.neighbours(five, 1, ["value"], (0, 0, 4, 4)).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.sum("n_value").alias("s")).where("cx = 0 AND cy = 0").first()
    assert clamped["n"] == 8 and clamped["s"] == 3 * 9 + 5


def test_ties_of_tops_are_stable(spark):
    df = cloud(spark, [(0.1, 0.1, 5), (0.2, 0.2, 5), (0.3, 0.3, 4)])
    for parts in (1, 3):
        assert s.cell_tops(df.repartition(parts), 1.0, ["id"]).first()["id"] == 0


def test_property_word(spark):
    df = spark.createDataFrame([(5, True, False, True), (300, False, True, False)], "t int, h boolean, o boolean, d boolean").withColumn("w", prop.pack(F.col("t"), F.col("h"), F.col("o"), F.col("d")))
    x, y = df.select(prop.segment(F.col("w")).alias("s"), prop.flag(F.col("w"), 8).alias("h"), prop.hidden(F.col("w"), [5]).alias("x"), prop.with_segment(F.col("w"), 9).alias("n")).collect()
    assert (x["s"], x["h"], x["x"], x["n"] & 255) == (5, True, True, 9) and (y["s"], y["h"], y["x"], y["n"] & 255) == (44, False, True, 44)


def test_las_round_trip(spark, tmp_path):
    rows = [(1.5, -2.25, 3.0001, i % 7, i, 2 * i, 255) for i in range(10)]
    las.write_las(spark.createDataFrame(rows, "x double, y double, z double, label int, r int, g int, b int").coalesce(1), f"{tmp_path}/out", epsg=32650)
    got = las.read_las(spark, f"{tmp_path}/out").orderBy("point_id").collect()
    assert [(round(v["x"], 4), round(v["y"], 4), round(v["z"], 4), v["label"], v["r"], v["g"], v["b"]) for v in got] == rows and {v["epsg"] for v in got} == {32650}
    assert las.read_las(spark, f"{tmp_path}/out").where("label = 99").count() == 0


def test_stream_of_tiles(spark, tmp_path):
    from spanlight.streaming import tiles

    cloud(spark, [(i, i, 1) for i in range(1000)]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, x double, y double, z double").parquet(f"{tmp_path}/in")
    tiles.append_tiles(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1000


def test_spatial_filter_refuses_unknown_shapes():
    with pytest.raises(ValueError):
        f.spatial("blob", None)


def brute_crowns(cells, th_tree, th_seed, th_crown, most):
    """cells: {(x, y): (z, seed)}; sweeps over the whole raster."""
    tree = {at: t for at, (_, t) in cells.items() if t}
    seeds = {t: (at, cells[at][0]) for at, t in tree.items()}
    total, count, changed = {t: z for t, (_, z) in seeds.items()}, dict.fromkeys(seeds, 1), True
    while changed:
        before, changed = dict(tree), False
        for x, y in sorted(before):
            t = before[x, y]
            (sx, sy), top = seeds[t]
            for at in ((x, y - 1), (x - 1, y), (x + 1, y), (x, y + 1)):
                h = cells.get(at, (-1.0, 0))[0]
                if at not in before and h > th_tree and h > top * th_seed and h > total[t] / count[t] * th_crown and h <= top * 1.05 and max(abs(at[0] - sx), abs(at[1] - sy)) < most:
                    tree[at], changed = t, True
                    total[t] += h
                    count[t] += 1
    return {(*at, t) for at, t in tree.items()}


def test_crowns_grow_over_the_whole_raster(spark):
    rnd = random.Random(5)
    cells = {(x, y): (float(rnd.randint(8, 60)), 0) for x in range(-30, 30) for y in range(15, 35) if rnd.random() < 0.9}
    for n, at in enumerate(rnd.sample(sorted(cells), 60), 1):
        cells[at] = (float(rnd.randint(40, 90)), n)
    cells |= {(24, 25): (80.0, 99), (25, 25): (70.0, 0), (26, 25): (65.0, 0), (27, 25): (60.0, 0)}
    df = spark.createDataFrame([(*at, *v) for at, v in cells.items()], "cx long, cy long, z double, seed long")
    got = {(r["cx"], r["cy"], r["tree"]) for r in c.crowns(df, 10.0, 0.45, 0.55, 4).collect()}
    assert got == brute_crowns(cells, 10.0, 0.45, 0.55, 4) and (25, 25, 99) in got
    assert c.crowns(df.where("seed = 0"), 10.0, 0.45, 0.55, 4).count() == 0


def test_farthest_points_against_a_plain_loop(spark):
    import random

    r = random.Random(7)
    rows = [(i, i % 3, r.randint(0, 9) * 1.0, r.randint(0, 9) * 1.0, 0.0) for i in range(90)] + [(100 + i, 9, 1.0, 1.0, 1.0) for i in range(4)]
    from spanlight.operators import sampling

    got = {(x["block"], x["rank"]): x["id"] for x in sampling.farthest_points(spark.createDataFrame(rows, "id long, block int, x double, y double, z double"), "block", "id", 6).collect()}
    for block in (0, 1, 2, 9):
        own = [x for x in rows if x[1] == block]
        chosen = [own[0]]
        while len(chosen) < 6:
            d, _, best = max((min(sum((a - b) ** 2 for a, b in zip(x[2:], c[2:])) for c in chosen), -x[0], x) for x in own)
            if d <= 0:
                break
            chosen.append(best)
        assert [got.get((block, i + 1)) for i in range(len(chosen) + 1)] == [c[0] for c in chosen] + ([None] if len(chosen) < 6 else [got.get((block, len(chosen) + 1))])


def test_chains(spark):
    from spanlight.operators import sampling

    rows = [("a", 1, 5.0, 0.0), ("a", 2, 0.0, 0.0), ("a", 3, 9.0, 0.0), ("a", 4, 6.0, 0.0), ("a", 5, 90.0, 0.0), ("b", 7, 1.0, 1.0)]
    got = sampling.chains(spark.createDataFrame(rows, "line string, tower long, x double, y double"), "line", "tower", 6.0).collect()
    assert {(r["line"], r["place"]): r["tower"] for r in got} == {("a", 1): 2, ("a", 2): 1, ("a", 3): 4, ("a", 4): 3, ("b", 1): 7}


def test_mesh_samples_lie_evenly_on_their_triangles(spark):
    from spanlight.operators import sampling

    a, b, c = (0.0, 0.0, 1.0), (4.0, 0.0, 1.0), (0.0, 2.0, 3.0)
    lit = lambda p: [F.lit(v) for v in p]
    rows = sampling.mesh_samples(spark.createDataFrame([(1,), (2,)], "id int"), "id", lit(a), lit(b), lit(c), 300.0).collect()
    n = int(300 * 4 * (2 * 2 + 2 * 2) ** 0.5 / 2)
    assert [sum(r["id"] == k for r in rows) for k in (1, 2)] == [n, n]
    inside = [(r["x"] / 4, r["y"] / 2) for r in rows]
    assert all(-1e-9 <= u and -1e-9 <= v and u + v <= 1 + 1e-9 and abs(r["z"] - 1 - r["y"]) < 1e-9 for (u, v), r in zip(inside, rows))
    assert abs(sum(u for u, _ in inside) / len(inside) - 1 / 3) < 0.02 and abs(sum(v for _, v in inside) / len(inside) - 1 / 3) < 0.02


def test_components_far_from_the_origin_in_small_voxels(spark):
    from spanlight.operators import graph

    base = [(0.0, 0.0, 0.0), (0.1, 0.0, 0.0), (0.2, 0.1, 0.1), (5.0, 5.0, 5.0), (5.1, 5.0, 5.0), (90_000.0, 40.0, -3.0), (-0.5, 0.0, 0.0)]
    rows = [(i, 500_000.05 + x, 4_000_000.05 + y, z + 0.05) for i, (x, y, z) in enumerate(base + base[:1])]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    grid = graph.Grid.of_points(df, 0.1)
    out = graph.voxel_components(df, 0.1, grid=grid)
    groups = {}
    for r in out.collect():
        groups.setdefault(r["component"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 7], [3, 4], [5], [6]]
    cells = {r["component"]: (r["x"], r["y"], r["z"]) for r in out.select("component", *grid.cell(F.col("component"), *"xyz")).distinct().collect()}
    first = {min(v): k for k, v in groups.items()}
    assert cells[first[5]] == (5_900_000, 40_000_400, -30)
    with pytest.raises(ValueError):
        graph.Grid.of_points(spark.createDataFrame([(0.0, 0.0, 0.0), (1e9, 1e9, 1e9)], "x double, y double, z double"), 0.1)
    assert graph.voxel_components(df.limit(0), 0.1).count() == 0


def test_points_near_a_tower_keep_repeated_rows(spark):
    from spanlight.operators import corridor

    towers = spark.createDataFrame([(1, 0.0, 0.0, 20.0), (2, 8.0, 0.0, 20.0)], "tower long, x double, y double, height double")
    rows = [(1.0, 1.0, 3.0)] * 3 + [(7.0, 0.0, 3.0), (7.0, 0.0, 0.5), (50.0, 0.0, 9.0), (4.0, 0.0, 3.0)]
    got = corridor.tower_points(spark.createDataFrame([(x, y, h, h) for x, y, h in rows], "x double, y double, z double, hag double"), towers, 5.0)
    assert sorted(((r["x"], r["hag"], r["tower"] or 0) for r in got.collect())) == sorted([(1.0, 3.0, 1)] * 3 + [(7.0, 3.0, 2), (7.0, 0.5, 0), (50.0, 9.0, 0), (4.0, 3.0, 1)])


def test_noise_of_mesh_samples(spark):
    lit = lambda p: [F.lit(float(v)) for v in p]
    mesh = spark.createDataFrame([(1,)], "id int")
    plain = {r["i"]: r for r in s.mesh_samples(mesh, "id", lit((0, 0, 0)), lit((2, 0, 0)), lit((0, 2, 0)), 200.0).collect()}
    noisy = s.mesh_samples(mesh, "id", lit((0, 0, 0)), lit((2, 0, 0)), lit((0, 2, 0)), 200.0, noise=lambda p, luck: (F.lit(0.0), p["x"] * 0, luck(0) - 0.5)).collect()
    assert len(noisy) == 400 and all((r["x"], r["y"]) == (plain[r["i"]]["x"], plain[r["i"]]["y"]) for r in noisy)
    z = [r["z"] for r in noisy]
    assert min(z) >= -0.5 and max(z) < 0.5 and abs(sum(z) / 400) < 0.06 and len(set(z)) > 390


def test_closest_pair_of_sides_far_apart(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0)], "id long, x double, y double, z double")
    far = spark.createDataFrame([(7, 3e12, 0.0, 0.0), (8, 3e12, 4.0, 0.0)], "id long, x double, y double, z double")
    assert [tuple(r) for r in j.closest_pair(one, far, "id", "id").collect()] == [(2, 7, 3e12 - 1)]
    assert j.closest_pair(one, far.limit(0), "id", "id").count() == 0 and j.closest_pair(one.limit(0), far, "id", "id").count() == 0
