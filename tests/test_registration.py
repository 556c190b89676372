"""Registration to planes and by sparse residuals: known motions, also with wrong points, and the defined results of odd inputs."""

import math

import numpy as np
import pytest

from spanlight.operators import registration as r
from spanlight.sources.staging import scratch, written

SCHEMA = "id long, x double, y double, z double"


def roof(n, seed):
    """Three walls of a corner, so that planes hold all directions."""
    rng = np.random.default_rng(seed)
    p = rng.uniform(0, 10, (n, 3))
    p[np.arange(n), rng.integers(0, 3, n)] = 0.0
    return p + np.array([500_000.0, 4_000_000.0, 100.0])


def rows(p):
    return [(i, *map(float, q)) for i, q in enumerate(p)]


def motion(p, angle, shift):
    c, s = math.cos(angle), math.sin(angle)
    m = p.mean(axis=0)
    return (p - m) @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + m + np.array(shift)


def writer(spark):
    base = scratch(spark, "registration-test")
    return lambda df, name: written(df, base, name)


def error(moved, wanted, count):
    got = np.array([[q.x, q.y, q.z] for q in moved.orderBy("id").limit(count).collect()])
    return np.abs(got - wanted[:count]).max()


def test_normals_of_planes(spark):
    p = roof(300, 1)
    got = {q.id: q for q in r.normals(spark.createDataFrame(rows(p), SCHEMA), "id", 6).collect()}
    low = np.array([500_000.0, 4_000_000.0, 100.0])
    flat = [i for i in range(300) if got[i].flatness < 1e-9]
    assert len(flat) > 200
    for i in flat:
        n, walls = [got[i].nx, got[i].ny, got[i].nz], p[i] - low < 1e-9
        assert any(walls[k] and abs(n[k] - 1) < 1e-6 for k in range(3))


def test_normals_need_neighbours(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0)], SCHEMA)
    assert r.normals(df, "id").count() == 0


def test_planar_step_against_numpy(spark):
    rng = np.random.default_rng(5)
    x, t, n, w = rng.normal(size=(50, 3)), rng.normal(size=(50, 3)), rng.normal(size=(50, 3)), rng.uniform(0.1, 1, 50)
    df = spark.createDataFrame([(*map(float, a), *map(float, b), *map(float, c), float(d)) for a, b, c, d in zip(x, t, n, w)], "x double, y double, z double, tx double, ty double, tz double, nx double, ny double, nz double, w double")
    a, g = np.hstack([np.cross(x, n), n]), ((t - x) * n).sum(axis=1)
    want = np.linalg.lstsq(a * np.sqrt(w)[:, None], g * np.sqrt(w), rcond=None)[0]
    rotation, shift, e = r.planar(df)
    assert np.allclose(rotation, r.turn(want[:3])) and np.allclose(shift, want[3:]) and math.isclose(e, (w * g * g).sum() / w.sum())


def test_shrinkage_is_the_least_cost(spark):
    p, mu = 0.4, 10.0
    lengths = [0.0, 0.1, 0.2, 0.3, 0.5, 1.0, 4.0]
    from pyspark.sql import functions as F

    got = [q.f for q in spark.createDataFrame([(v,) for v in lengths], "v double").select("v", r.shrinkage(F.col("v"), p, mu).alias("f")).orderBy("v").collect()]
    grid = np.linspace(0, 1, 200_001)
    for v, f in zip(lengths, got):
        cost = (grid * v) ** p + mu / 2 * (grid * v - v) ** 2
        assert v == 0 and f == 0 or abs(f - grid[cost.argmin()]) < 2e-3


@pytest.mark.parametrize("robust, within", [(None, 0.1), (0.004, 0.01)])
def test_to_planes(spark, robust, within):
    target, source = roof(500, 2), roof(200, 3)
    start = motion(source, 0.05, (0.2, -0.15, 0.1))
    at, rotation, _ = r.aligned(spark.createDataFrame(rows(start), SCHEMA), spark.createDataFrame(rows(target), SCHEMA), "id", "id", writer(spark), "planes", 5, flat=1e-6, robust=robust, start=0.06)
    # The source has no points of the target: only distances to the planes can vanish; beside edges some meet the wrong plane.
    assert error(at, source, 200) < within and np.allclose(rotation @ rotation.T, np.eye(3))


def test_sparse_with_wrong_points(spark):
    target = roof(350, 4)
    rng = np.random.default_rng(6)
    start = motion(target, 0.02, (0.1, -0.08, 0.06))
    wrong = start[:105] + rng.uniform(1, 4, (105, 3))  # 30 % of the points
    start = np.vstack([start[105:], wrong])
    at, _, _ = r.aligned(spark.createDataFrame(rows(start), SCHEMA), spark.createDataFrame(rows(target), SCHEMA), "id", "id", writer(spark), "sparse", 5, start=0.06)
    assert error(at, target[105:], 245) < 0.01


def test_odd_inputs(spark):
    some, none = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], SCHEMA), spark.createDataFrame([], SCHEMA)
    for method in ("planes", "sparse"):
        assert r.aligned(some, none, "id", "id", writer(spark), method)[0].collect() == some.collect()
        assert r.aligned(none, some, "id", "id", writer(spark), method)[0].count() == 0
    at = r.aligned(spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, None, 1.0, 1.0)], SCHEMA), some, "id", "id", writer(spark), "sparse", 2)[0]
    assert sorted((q.id, q.x) for q in at.where("x IS NOT NULL").collect()) == [(1, 1.0)] and at.count() == 2
