import itertools
import math
import random
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlight.functions import delaunay
from spanlight.operators import terrain


def circle(p, a, b, c):
    """Sign of the determinant that tells whether p is in the circle of a, b, c, exact."""
    (ax, ay), (bx, by), (cx, cy) = [(Fraction(q[0]) - Fraction(p[0]), Fraction(q[1]) - Fraction(p[1])) for q in (a, b, c)]
    turn = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    d = (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay)
    return d * turn


def plain(points):
    """Triples whose circle holds no other point (points in general position)."""
    out = set()
    for t in itertools.combinations(points, 3):
        (ax, ay), (bx, by), (cx, cy) = t
        if (bx - ax) * (cy - ay) != (by - ay) * (cx - ax) and all(circle(p, *t) < 0 for p in points if p not in t):
            out.add(frozenset(t))
    return out


def local(points):
    found = delaunay.triangles([p[0] for p in points], [p[1] for p in points])
    return {frozenset(points[k] for k in t) for t in found if t[2] != delaunay.OUTSIDE}


def area(t):
    (ax, ay), (bx, by), (cx, cy) = t
    return abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / 2


def test_one_tile_against_all_triples():
    r = random.Random(1)
    points = [(r.uniform(0, 9), r.gauss(0, 3)) for _ in range(36)]
    assert local(points) == plain(points)
    assert local([]) == local([(1.0, 1.0), (2.0, 2.0)]) == local([(float(i), 2.0 * i) for i in range(9)]) == set()


def test_cocircular_and_collinear_points_fill_the_hull():
    grid = [(float(x), float(y)) for x in range(7) for y in range(6)]
    for points in (grid, random.Random(3).sample(grid, 42), [(x * 0.1, y * 0.1) for x, y in grid], [(math.cos(i), math.sin(i)) for i in range(12)] + [(0.0, 0.0)]):
        found = local(points)
        assert all(circle(p, *sorted(t)) <= 1e-12 for t in found for p in points if p not in t)
        if set(points) == set(grid):
            assert len(found) == 60 and math.isclose(sum(map(area, map(tuple, found))), 30)
    # the order of points doesn't matter, as cocircular ones are told apart by place
    assert len({frozenset(local(random.Random(s).sample(grid, 42))) for s in range(5)}) == 1


def collected(df):
    rows = [tuple((r[k]["x"], r[k]["y"]) for k in "abc") for r in df.collect()]
    out = {frozenset(t) for t in rows}
    assert len(out) == len(rows) and all((b[0] - a[0]) * (c[1] - a[1]) > (b[1] - a[1]) * (c[0] - a[0]) for a, b, c in rows)
    return out


def frame(spark, points):
    return spark.createDataFrame([(x, y, x - 2 * y) for x, y in points], "x double, y double, z double")


@pytest.mark.parametrize("kind", ["even", "uneven", "grid"])
def test_tiles_leave_no_trace(spark, kind):
    r = random.Random(4)
    points = {
        "even": [(r.uniform(0, 100), r.uniform(0, 100)) for _ in range(5000)],
        "uneven": [(r.gauss(0, 1), r.gauss(0, 1)) for _ in range(900)] + [(r.uniform(-500, 500), r.uniform(-500, 500)) for _ in range(500)] + [(300 + math.cos(i), math.sin(i)) for i in range(200)],
        "grid": [(float(x), float(y)) for x in range(40) for y in range(30)],
    }[kind]
    want = local(points)
    assert collected(terrain.triangulation(frame(spark, points), 400)) == want
    if kind == "grid":
        assert collected(terrain.triangulation(frame(spark, points), 150)) == want


def test_nulls_repeated_places_and_empty(spark):
    rows = [(0.0, 0.0, 5.0), (0.0, 0.0, 1.0), (4.0, 0.0, 1.0), (0.0, 4.0, 1.0), (None, 1.0, 1.0), (1.0, float("nan"), 1.0), (1.0, 1.0, None), (-0.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    (t,) = terrain.triangulation(df).collect()
    assert {t[k]["z"] for k in "abc"} == {1.0}
    assert terrain.triangulation(df.limit(0)).count() == 0 and terrain.terrain(df.limit(0), 1.0).count() == 0
    assert terrain.triangulation(df.where("y = 0")).count() == 0


def test_heights_of_a_plane_and_cells_of_triangles(spark):
    r = random.Random(6)
    points = [(r.uniform(0, 30), r.uniform(0, 20)) for _ in range(400)]
    cells = {(c["cx"], c["cy"]): c["value"] for c in terrain.terrain(frame(spark, points), 0.5, tile_points=60).collect()}
    assert all(math.isclose(v, (cx + 0.5) * 0.5 - (cy + 0.5), abs_tol=1e-9) for (cx, cy), v in cells.items())
    assert 60 * 40 * 0.85 < len(cells) <= 2400
    exact = spark.createDataFrame([(0.0, 0.0, 0.0), (4.0, 0.0, 4.0), (0.0, 4.0, 0.0), (4.0, 4.0, 4.0)], "x double, y double, z double")
    got = {(c["cx"], c["cy"]): c["value"] for c in terrain.terrain(exact, 1.0).collect()}
    assert got.keys() == {(x, y) for x in range(4) for y in range(4)} and all(math.isclose(v, cx + 0.5) for (cx, _), v in got.items())


def test_heights_above_ground(spark):
    ground = [(float(x), float(y), 0.1 * x, 1) for x in range(0, 40, 2) for y in range(0, 40, 2)]
    df = spark.createDataFrame(ground + [(10.5, 10.5, 1.05 + 7, 15), (900.0, 900.0, 50.0, 15)], "x double, y double, z double, seg_type int")
    got = {r["x"]: r["hag"] for r in terrain.normalised(df, tile_points=100).where(F.col("seg_type") == 15).collect()}
    assert math.isclose(got[10.5], 7, abs_tol=1e-9) and got[900.0] == 0


def cycles(found):
    """Triangles as cycles from their least corner, those beyond the hull as they are."""
    rows = [tuple(map(int, t)) for t in found]
    return {t if t[2] == delaunay.OUTSIDE else t[(k := t.index(min(t))) :] + t[:k] for t in rows}


def test_many_sets_at_once_are_the_sets_one_by_one():
    r = random.Random(4)
    sets = [[(r.uniform(0, 100), r.gauss(0, 9)) for _ in range(700)], [(x * 0.1, y * 0.1) for x in range(20) for y in range(20)], [], [(1.0, 1.0)], [(float(i), 2.0 * i) for i in range(9)]]
    sets += [[(math.cos(i), math.sin(i)) for i in range(200)] + [(0.0, 0.0)], list({(r.randrange(90000, 100000) / 100.0, float(r.randrange(8))) for _ in range(250)})]
    sets += [list({(float(r.randrange(6)), float(r.randrange(6))) for _ in range(r.randrange(20))}) for _ in range(200)]
    group = [i for i, s in enumerate(sets) for _ in s]
    want, before = set(), 0
    for s in sets:
        want |= cycles([[v if v == delaunay.OUTSIDE else v + before for v in t] for t in delaunay.triangles([p[0] for p in s], [p[1] for p in s])])
        before += len(s)
    found = delaunay.many(np.array(group), np.array([p[0] for s in sets for p in s]), np.array([p[1] for s in sets for p in s]))
    assert len(found) == len(want) and cycles(found) == want


def test_dense_lines_take_no_longer_than_their_points(spark):
    # far more points along lines than across them, as more of the driver's points get
    n, lines = 24_000, 8
    df = spark.range(n).select((F.expr(f"id div {lines}") * 7 / 100.0).alias("x"), (F.col("id") % lines).cast("double").alias("y"), F.lit(1.0).alias("z"))
    began = time.time()
    found = terrain.triangulation(df)
    assert found.count() == 2 * (n - 1) - (2 * (n // lines) + 2 * lines - 4)
    assert time.time() - began < 100
