"""Poles: a leaning and a straight pole among trees, labels of their points, odd inputs."""

import math

import numpy as np

from spanlight.operators import poles as p

SCHEMA = "id long, kind string, x double, y double, z double"


def scene():
    rng, out = np.random.default_rng(3), []
    for k, (x, y, lean) in enumerate(((10.0, 10.0, 0.0), (30.0, 12.0, 0.03))):
        for z in np.arange(0.05, 10.0, 0.05):
            a = rng.uniform(0, 2 * math.pi)
            out.append((f"pole{k}", x + lean * z + 0.12 * math.cos(a), y + 0.12 * math.sin(a), z))
    for x, y in ((18.0, 10.0), (22.0, 14.0)):  # trees: a stem of three metres and a wide crown
        for z in np.arange(0.05, 3.0, 0.05):
            out.append(("stem", x + rng.uniform(-0.1, 0.1), y + rng.uniform(-0.1, 0.1), z))
        for q in rng.uniform(-1, 1, (3000, 3)):
            out.append(("crown", x + 2.5 * q[0], y + 2.5 * q[1], 6 + 3 * q[2]))
    for q in rng.uniform(0, 40, (2000, 2)):
        out.append(("ground", q[0], q[1], rng.uniform(-0.1, 0.0)))
    return [(i, k, float(x), float(y), float(z)) for i, (k, x, y, z) in enumerate(out)]


def test_poles_among_trees(spark):
    df = spark.createDataFrame(scene(), SCHEMA)
    found = sorted(p.trunks(df, 1.0, 0.2, 0.25, 0.8, 6).collect(), key=lambda q: q.mx)
    assert [q.layers for q in found] == [10, 10]
    assert abs(found[0].mx - 10) < 0.1 and abs(found[1].my - 12) < 0.1
    assert abs(found[0].ux) < 0.01 and abs(found[1].ux / found[1].uz - 0.03) < 0.01
    poles = p.trunks(df, 1.0, 0.2, 0.25, 0.8, 6)
    got = p.pole_points(df, poles, 0.4)
    assert got.count() == df.count()
    kinds = {(q.kind, q.trunk is not None): q["count"] for q in got.groupBy("kind", "trunk").count().collect()}
    for k in ("pole0", "pole1"):
        assert kinds[(k, True)] == 199 and (k, False) not in kinds
    assert ("stem", True) not in kinds and ("crown", True) not in kinds


def test_labels_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    pts = [(i, *map(float, q)) for i, q in enumerate(rng.uniform(-2, 8, (600, 3)))]
    axes = []
    for t in range(8):
        u = rng.normal(size=3) * [0.3, 0.3, 0] + [0, 0, 1]
        u /= np.linalg.norm(u)
        axes.append((t, 1.0, 5.0, *map(float, rng.uniform(0, 6, 2)), 3.0, *map(float, u)))
    df = spark.createDataFrame(pts, "id long, x double, y double, z double")
    poles = spark.createDataFrame(axes, "trunk long, z1 double, z2 double, mx double, my double, mz double, ux double, uy double, uz double")
    got = {q.id: q.trunk for q in p.pole_points(df, poles, 0.7).collect()}
    for i, *q in pts:
        best = min(((float(np.linalg.norm(np.cross(np.array(q) - a[3:6], a[6:9]))), a[0]) for a in axes if 0.5 <= q[2] <= 5.5), default=(9.0, None))
        assert got[i] == (best[1] if best[0] < 0.7 else None)


def test_odd_points(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert p.trunks(none, 1.0, 0.2).count() == 0
    few = spark.createDataFrame([(1, "a", 1.0, 1.0, 1.0)] * 3 + [(2, "b", None, 1.0, float("nan"))], SCHEMA)
    poles = p.trunks(few, 1.0, 0.2)
    assert poles.count() == 0 and p.pole_points(few, poles, 0.3).where("trunk IS NULL").count() == 4
