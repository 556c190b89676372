"""Towers, wires, roofs, planes, curves and registration against clouds whose parts are known."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlight.operators import corridor, fits, graph, raster
from spanlight.sources.files import Options
from spanlight.sources.staging import scratch, written


def writer(spark):
    base = scratch(spark, "test")
    return lambda df, name: written(df, base, name)


def line_of_towers():
    """Three towers 60 apart along x, two wires in each span, ground and a few bushes; rows (id, x, y, z, seg_type, hag, part)."""
    r, rows = random.Random(2), []
    add = lambda x, y, z, part: rows.append((len(rows), x, y, z, 1 if part == "ground" else 255, z, part))
    for x in range(0, 140, 4):
        for y in range(-20, 24, 4):
            add(x + 0.5, y + 0.5, 0.0, "ground")
    for tower in (10, 70, 130):
        for i in range(400):
            add(tower + r.uniform(-1, 1), r.uniform(-1, 1), 30 * i / 400 + 0.5, "tower")
    for span in (10, 70):
        for y in (-5, 5):
            for i in range(200):
                t = 4 + 52 * i / 199
                add(span + t, y + r.uniform(-0.05, 0.05), 20 + 0.005 * (t - 30) ** 2, "wire")
    for _ in range(60):
        add(r.uniform(30, 50), r.uniform(-15, 15), r.uniform(0.2, 2), "bush")
    return rows


SCHEMA = "id long, x double, y double, z double, seg_type int, hag double, part string"


@pytest.fixture(scope="module")
def cloud(spark):
    return written(spark.createDataFrame(line_of_towers(), SCHEMA), scratch(spark, "cloud"), "points")


def test_towers_in_order(spark, cloud):
    t = corridor.tower_positions(cloud, 4.0, 15.0, 4.0, 1.0, 0.5, 10.0).orderBy("tower").collect()
    assert [r["tower"] for r in t] == [1, 2, 3]
    assert [r["x"] for r in t] == pytest.approx([10, 70, 130], abs=4) and [abs(r["y"]) < 4 for r in t] == [True] * 3


def test_corridor_labels_towers_and_wires(spark, cloud):
    towers = spark.createDataFrame([(i + 1, 10.0 + 60 * i, 0.0, 30.0) for i in range(3)], "tower long, x double, y double, height double")
    out = corridor.corridor(cloud, "id", 4.0, 15.0, towers, 3.0, reach=8.0)
    got = {(r["part"], r["seg_type"]): r["count"] for r in out.groupBy("part", "seg_type").count().collect()}
    assert got["wire", 4] == 800 and ("wire", 255) not in got and got["tower", 3] > 1100 and got["bush", 255] == 60 and ("ground", 1) in got
    alone = corridor.corridor(cloud, "id", 4.0, 15.0, towers.limit(1), 3.0)
    assert alone.where("seg_type IN (3, 4)").isEmpty()


def test_hang_points(spark, cloud):
    towers = spark.createDataFrame([(i + 1, 10.0 + 60 * i, 0.0) for i in range(3)], "tower long, x double, y double")
    spans = corridor.spans(towers)
    fitted, _ = corridor.wires(cloud, spans, "id", reach=8.0)
    at = corridor.hang_points(fitted, spans).collect()
    assert len(at) == 8
    for r in at:
        assert min(abs(r["x"] - x) for x in (10, 70, 130)) < 0.5 and abs(abs(r["y"]) - 5) < 0.2 and r["z"] == pytest.approx(20 + 0.005 * 900, abs=0.3)


def test_roofs(spark):
    r, rows = random.Random(4), []
    for i in range(20):
        for j in range(20):
            rows.append((len(rows), i * 0.5, j * 0.5, 5 + 0.3 * i * 0.5 + r.uniform(-0.05, 0.05), 255, 5.0, "roof"))
    for _ in range(300):
        rows.append((len(rows), 40 + r.uniform(0, 5), r.uniform(0, 5), 4 + r.uniform(0, 5), 255, 5.0, "tree"))
    df = spark.createDataFrame(rows, SCHEMA)
    found = df.join(corridor.buildings(df, "id"), "id", "left_semi").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in found} == {"roof": 400}


def test_planes_one_after_another(spark):
    r, rows = random.Random(6), []
    for i in range(150):
        rows.append((len(rows), 1, r.uniform(0, 10), r.uniform(0, 10), 3.0))
    for i in range(90):
        x, y = r.uniform(0, 10), r.uniform(0, 10)
        rows.append((len(rows), 1, x, y, 8 + x))
    df = spark.createDataFrame(rows, "id long, part int, x double, y double, z double")
    got = fits.planes(df, "part", ["id"], 0.01, 20, 4, writer(spark), 40).orderBy("round").collect()
    assert [g["inliers"] for g in got] == [150, 90] and abs(got[0]["nz"]) == pytest.approx(1)
    assert abs(got[1]["nx"]) == pytest.approx(math.sqrt(0.5), abs=1e-6)


def test_only_places_are_written_for_wires_and_roofs(spark):
    from spanlight.plans import corridor_queries as q

    assert q.with_id(spark, "/root/testdata/sf0.001", *q.PLACE).columns == ["x", "y", "z", "seg_type", "id"]
    assert {*q.KEY, "display_enable", "seg_type", "id"} <= set(q.with_id(spark, "/root/testdata/sf0.001").columns)


def test_planes_of_large_groups(spark, monkeypatch):
    r = random.Random(11)
    rows = [(i, i % 7 * (i % 3 == 0), r.uniform(0, 10), r.uniform(0, 10), r.choice([3.0, r.uniform(0, 9)])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, part int, x double, y double, z double")
    # no tries of points are sorted, or spilled
    assert "SortAggregate" not in fits.picks(df, "part", ["id"], 8, 3, 0)._jdf.queryExecution().executedPlan().toString()
    got = []
    for most in (1, 60, 1 << 40):  # groups that go to all tasks: all, some, none
        monkeypatch.setattr(fits, "GROUP_POINTS", most)
        got.append((sorted(fits.best_planes(df, "part", ["id"], 0.01).collect()), sorted((r["part"], r["inliers"], round(r["mx"], 6)) for r in fits.best_lines(df, "part", ["id"], 0.1).collect())))
    assert got[0] == got[1] == got[2] and [r["part"] for r in got[0][0]] == list(range(7))


def test_polynomials_against_numpy(spark):
    r = np.random.default_rng(3)
    y = r.uniform(100, 160, 300)
    z = np.sin(y / 9) * 4 + r.normal(0, 0.1, 300)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(y, z)] + [(2, 5.0, 1.5)] * 3, "k int, y double, z double")
    f = fits.polynomial_fit(df, "k", 7)
    got = df.join(f, "k").select("k", "y", fits.polynomial_at(F.col("y")).alias("v")).collect()
    want = np.polynomial.Polynomial.fit(y, z, 7)
    assert all(g["v"] == pytest.approx(want(g["y"]) if g["k"] == 1 else 1.5, abs=1e-6) for g in got)


def test_registration_finds_the_motion(spark):
    r = np.random.default_rng(8)
    at = r.uniform(0, 1, (300, 3))
    turn = 0.06
    rotation = np.array([[math.cos(turn), -math.sin(turn), 0], [math.sin(turn), math.cos(turn), 0], [0, 0, 1.0]])
    goal = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, x double, y double, z double")
    start = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at @ rotation.T + [0.02, -0.01, 0.01])], "id long, x double, y double, z double")
    got, error = fits.registered(start, goal, "id", "id", writer(spark), 25, 0.1)
    assert error < 1e-6
    assert all(math.dist([r["x"], r["y"], r["z"]], at[r["id"]]) < 1e-3 for r in got.collect())


def test_lines(spark):
    rows = [(i, 1, i * 0.8, 3 + i * 0.6, 0.0) for i in range(50)] + [(50 + i, 1, float(i), 30.0 - i * i % 17, 0.0) for i in range(15)]
    got = fits.best_lines(spark.createDataFrame(rows, "id long, k int, x double, y double, z double"), "k", ["id"], 0.01, 60).first()
    assert got["inliers"] >= 50 and (got["ux"], got["uy"]) == pytest.approx((0.8, 0.6), abs=1e-3)


def test_thinning_against_an_array(spark):
    r = random.Random(9)
    cells = {(x, y) for x in range(14) for y in range(12) if 2 < x < 11 and 3 < y < 9 or r.random() < 0.25}

    def step(now, first):
        gone = set()
        for x, y in now:
            n = [(x + dx, y + dy) in now for dx, dy in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))]
            turns = sum(not n[i] and n[(i + 1) % 8] for i in range(8))
            sides = (n[0] and n[2] and n[4], n[2] and n[4] and n[6]) if first else (n[0] and n[2] and n[6], n[0] and n[4] and n[6])
            if 2 <= sum(n) <= 6 and turns == 1 and not any(sides):
                gone.add((x, y))
        return gone

    now, i, idle = set(cells), 0, 0
    while idle < 2:
        gone = step(now, i % 2 == 0)
        now, i, idle = now - gone, i + 1, 0 if gone else idle + 1
    got = raster.thinned(spark.createDataFrame(list(cells), "cx long, cy long"))
    assert {tuple(c) for c in got.collect()} == now


def test_hulls_hold_all_corners(spark):
    r = random.Random(1)
    cells = [(k, r.randint(-9, 9), r.randint(-5, 5)) for k in (1, 2) for _ in range(30)] + [(3, 4, 4)]
    got = {row["k"]: [(p["x"], p["y"]) for p in row["ring"]] for row in raster.hulls(spark.createDataFrame(cells, "k int, cx long, cy long"), "k").collect()}
    assert got[3] == [(4, 4), (5, 4), (5, 5), (4, 5)]
    for k, x, y in cells:
        ring = got[k]
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            assert all((bx - ax) * (y + dy - ay) - (by - ay) * (x + dx - ax) >= 0 for dx in (0, 1) for dy in (0, 1))


def test_kinds_options_and_growing(spark):
    with pytest.raises(ValueError):
        corridor.create("dreams")
    said = []
    df = spark.createDataFrame([(i, float(i % 10), float(i // 10), 0.0 if i % 7 else 5.0, 255) for i in range(100)], "id long, x double, y double, z double, seg_type int")
    out = corridor.segmented(df, "id", Options(kinds="ground", cell=2.0), progress=lambda *a: said.append(a))
    assert said == [("ground", 1, 1)] and out.where("seg_type = 1").count() == 85
    cells = spark.createDataFrame([(0, 0, 9), (1, 0, 7), (2, 0, 8), (3, 0, 1), (1, 1, 5), (0, 5, 1)], "cx long, cy long, top int")
    got = graph.grown_from(cells, F.col("top") == 9, F.col("n_top") <= F.col("top"), ("top",))
    assert {(r["cx"], r["cy"]) for r in got.collect()} == {(0, 0), (1, 0), (1, 1)}


def test_tower_parts(spark, cloud):
    towers = spark.createDataFrame([(i + 1, 10.0 + 60 * i, 0.0) for i in range(3)], "tower long, x double, y double")
    rows = cloud.withColumnRenamed("part", "true").join(corridor.tower_parts(cloud, towers, "id", 4.0, 1.0, 6.0), "id").collect()
    assert sum(r["true"] == "tower" for r in rows) > 1100 and {r["true"] for r in rows} <= {"tower", "wire"} and all((r["part"] == "head") == (r["z"] > 24.4) for r in rows if abs(r["z"] - 24.4) > 0.2)


def test_linear_points(spark, cloud):
    kept = corridor.linear_points(cloud.where("part IN ('wire', 'bush')"), 2.0, 0.95).groupBy("part").count().collect()
    n = {r["part"]: r["count"] for r in kept}
    assert n["wire"] == 800 and n.get("bush", 0) < 30
