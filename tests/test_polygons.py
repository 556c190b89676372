import math
import random

import pytest
from pyspark.sql import functions as F

from spanlight.operators import polygons as P


def frame(spark, rings):
    return spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rings)], "id long, ring array<struct<x: double, y: double>>")


def inside(x, y, ring):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and (y - ay) * (bx - ax) / (by - ay) + ax > x:
            hit = not hit
    return hit


def closed(rows):
    rings = {}
    for r in rows:
        rings.setdefault(r["ring"], {})[r["place"]] = (r["x"], r["y"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in rings.values())
    return [[v[k] for k in sorted(v)] for v in rings.values()]


def area(ring):
    return sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])) / 2


def square(x, y, w=2.0, h=None, turn=False):
    r = [(x, y), (x + w, y), (x + w, y + (h or w)), (x, y + (h or w))]
    return r[::-1] if turn else r


@pytest.mark.parametrize("rings, areas", [
    ([square(0, 0), square(1, 1, turn=True)], [7.0]),
    ([square(0, 0), square(2, 0), square(0, 0)], [8.0]),  # a shared side, and a copy
    ([square(0, 0), square(2, 2)], [4.0, 4.0]),  # a shared corner
    ([square(0, 0, 5), square(1, 1)], [25.0]),  # one holds the other
    ([square(0, 0, 6, 1), square(0, 5, 6, 1), square(0, 0, 1, 6), square(5, 0, 1, 6)], [-16.0, 36.0]),  # a hole
    ([square(0, 0), square(9, 9), [(0, 0), (1, 1), (2, 2)], [(0, 0), (1, 0)]], [4.0, 4.0]),
    ([square(0, 0), square(2, 0.5, 2, 1)], [6.0]),  # part of a side
    ([], []),
])
def test_known_unions(spark, rings, areas):
    assert sorted(round(area(r), 6) for r in closed(P.union(frame(spark, rings)).collect())) == areas


def test_random_polygons_against_points(spark):
    r = random.Random(9)
    rings = []
    for _ in range(25):
        x, y, n = r.uniform(0, 60), r.uniform(0, 60), r.randint(3, 9)
        rings.append([(x + rad * math.cos(2 * math.pi * k / n), y + rad * math.sin(2 * math.pi * k / n)) for k in range(n) for rad in [r.uniform(3, 12)]])
    rings += [square(i * 4, j * 4, 4) for i in range(3) for j in range(3)] + [rings[0]]
    found = P.union(frame(spark, rings))
    got = closed(found.collect())
    for _ in range(3000):
        x, y = r.uniform(-15, 75), r.uniform(-15, 75)
        assert any(inside(x, y, p) for p in rings) == (sum(inside(x, y, p) for p in got) % 2 == 1)
    areas = {a["ring"]: a["area"] for a in P.ring_areas(found).collect()}
    assert math.isclose(sum(areas.values()), sum(map(area, got)), abs_tol=1e-6) and len(areas) == len(got)


def test_corners_and_simplification(spark):
    found = P.union(frame(spark, [square(0, 0), square(2, 0)]))
    assert found.count() == 6 and sorted((c["x"], c["y"]) for c in P.corners(found).collect()) == [(0, 0), (0, 2), (4, 0), (4, 2)]
    df = frame(spark, [[(0, 0), (0.1, 0), (5, 0), (5, 5), (0, 0.05), (4.95, 5)]])
    assert [tuple(p) for p in df.select(P.simplified(F.col("ring"), 0.5).alias("r")).first()["r"]] == [(0, 0), (5, 0), (5, 5)]
