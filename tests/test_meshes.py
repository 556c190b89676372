"""Clipped meshes: cubes with known area and volume, normals along cuts, odd inputs."""

import math

from pyspark.sql import functions as F

from spanlight.operators import meshes as m


def cube(spark, low=0.0, high=2.0):
    """Twelve outward triangles, with the normals of a ball at the corners."""
    out, mid = [], (low + high) / 2
    for axis in range(3):
        for side in (low, high):
            a, b = (axis + 1) % 3, (axis + 2) % 3
            square = []
            for s, t in ((low, low), (high, low), (high, high), (low, high)):
                p = [0.0, 0.0, 0.0]
                p[axis], p[a], p[b] = side, s, t
                n = [(v - mid) / math.sqrt(3) / ((high - low) / 2) for v in p]
                square.append(p + n)
            if side == low:
                square.reverse()
            out += [(axis, [square[0], square[1], square[2]]), (axis, [square[0], square[2], square[3]])]
    return spark.createDataFrame(out, "axis int, ring array<array<double>>")


def total(df, f):
    return df.agg(F.sum(f(F.col("ring"))).alias("v")).first()["v"] or 0.0


def test_whole_cube(spark):
    c = cube(spark)
    assert math.isclose(total(c, m.area), 24.0) and math.isclose(total(c, m.volume_share), 8.0)
    assert math.isclose(total(c, lambda r: m.volume_share(r, (5.0, -3.0, 1.0))), 8.0)
    kept = m.clipped(c, "ring", m.box_planes((-1, -1, -1), (3, 3, 3)))
    assert kept.count() == 12 and math.isclose(total(kept, m.area), 24.0)


def test_half_and_corner(spark):
    c = cube(spark)
    half = m.clipped(c, "ring", [m.plane((0, 0, 1), (0, 0, 1))])
    assert math.isclose(total(half, m.area), 4.0 + 4 * 2.0)  # the lid and four half walls
    # Seen from a place on the cut its open side takes no volume.
    assert math.isclose(total(half, lambda r: m.volume_share(r, (0.3, 0.4, 1.0))), 4.0)
    tip = m.clipped(c, "ring", [m.plane((1, 1, 1), (2, 2, 1))])
    assert math.isclose(total(tip, m.area), 3 * 0.5) and math.isclose(total(tip, lambda r: m.volume_share(r, (2.0, 2.0, 1.0))), 1 / 6)
    inner = m.clipped(c, "ring", m.box_planes((0.5, 0.5, -1), (1.5, 1.25, 3)))
    assert math.isclose(total(inner, m.area), 2 * 0.75)  # the window in floor and lid


def test_turned_box(spark):
    t = 0.6
    axes = [(math.cos(t), math.sin(t), 0), (-math.sin(t), math.cos(t), 0), (0, 0, 1)]
    got = m.clipped(cube(spark), "ring", m.turned_box_planes((1, 1, 1), axes, (0.5, 0.25, 4)))
    assert math.isclose(total(got, m.area), 2 * 0.5)


def test_normals_along_cuts(spark):
    got = m.clipped(cube(spark), "ring", [m.plane((1, 0, 0), (1, 0, 0))])
    for (ring,) in got.select("ring").collect():
        for x, y, z, nx, ny, nz in ring:
            assert math.isclose(nx * nx + ny * ny + nz * nz, 1.0)
            size = math.sqrt((x - 1) ** 2 + (y - 1) ** 2 + (z - 1) ** 2)
            if size > 1.4:  # places at the middle of an edge or a corner: by symmetry away from the middle
                assert abs(nx - (x - 1) / size) < 1e-9 and abs(ny - (y - 1) / size) < 1e-9 and abs(nz - (z - 1) / size) < 1e-9


def test_odd_rings(spark):
    rows = [(1, [[0.0] * 6] * 3), (2, []), (3, [[0.0, 0.0, None, 0.0, 0.0, 0.0]] * 3), (4, [[float("nan")] + [0.0] * 5] * 3), (5, None)]
    df = spark.createDataFrame(rows, "id int, ring array<array<double>>")
    got = {q.id: q for q in df.select("id", m.cut(F.col("ring"), m.box_planes((0, 0, 0), (1, 1, 1))).alias("r")).select("*", m.area(F.col("r")).alias("area")).collect()}
    assert got[1].area == 0 and got[2].r == [] and got[2].area == 0 and got[3].r is None and got[4].r is None and got[5].r is None
    assert m.clipped(df.where("id > 1"), "ring", m.box_planes((0, 0, 0), (1, 1, 1))).count() == 0
