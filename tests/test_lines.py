"""Line segments: known edges come out, noise doesn't, and the parts agree with plain versions."""

import math

import numpy as np

from spanlight.operators import lines as l

SCHEMA = "cx long, cy long, value double"


def raster(a):
    return [(int(x), int(y), float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1]) if a[y, x]]


def test_level_lines_against_numpy(spark):
    a = np.zeros((12, 12))
    a[2:10, 2:10] = np.random.default_rng(1).random((8, 8))
    got = {(q.cx, q.cy): q for q in l.level_lines(l.blurred(spark.createDataFrame(raster(a), SCHEMA))).collect()}
    k = np.array([0.25, 0.5, 0.25])
    b = np.apply_along_axis(lambda r: np.convolve(r, k, "same"), 0, np.apply_along_axis(lambda r: np.convolve(r, k, "same"), 1, a))
    for y in range(11):
        for x in range(11):
            gx, gy = (b[y, x + 1] + b[y + 1, x + 1] - b[y, x] - b[y + 1, x]) / 2, (b[y + 1, x] + b[y + 1, x + 1] - b[y, x] - b[y, x + 1]) / 2
            q = got.get((x, y))
            assert q and abs(q["size"] - math.hypot(gx, gy)) < 1e-12 and abs(math.remainder(q.angle - math.atan2(gx, -gy), 2 * math.pi)) < 1e-9 or math.hypot(gx, gy) < 1e-12


def test_tail_against_sums():
    for n, k, p in ((10, 3, 0.125), (50, 40, 0.125), (200, 10, 0.125), (30, 0, 0.3), (5, 5, 0.5), (3000, 900, 0.125)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)) if n < 300 else None
        got = l.log_tail(n, k, p)
        assert got <= 0 and (want is None or math.isclose(got, min(math.log10(want), 0.0), rel_tol=1e-9, abs_tol=1e-12))


def test_covered_cells_against_all(spark):
    boxes = [(i, 5.3 * i, 3.1, math.cos(t), math.sin(t), -6.2, 9.7, -1.37, 2.23) for i, t in enumerate((0.0, 0.4, math.pi / 2, 2.5, -1.1))]
    df = spark.createDataFrame(boxes, "region int, mx double, my double, ux double, uy double, t1 double, t2 double, s1 double, s2 double")
    want = set()
    for i, mx, my, ux, uy, t1, t2, s1, s2 in boxes:
        for x in range(-40, 60):
            for y in range(-40, 60):
                t, s = (x - mx) * ux + (y - my) * uy, (y - my) * ux - (x - mx) * uy
                if t1 <= t <= t2 and s1 <= s <= s2:
                    want.add((i, x, y))
    assert {tuple(q) for q in l.covered(df).collect()} == want


def test_square_and_noise(spark):
    """A filled, turned square has four sides; scattered cells have none."""
    n, turn, half = 120, 0.3, 25.0
    y, x = np.mgrid[0:n, 0:n]
    u, v = (x - 60) * math.cos(turn) + (y - 60) * math.sin(turn), (y - 60) * math.cos(turn) - (x - 60) * math.sin(turn)
    a = ((abs(u) <= half) & (abs(v) <= half)).astype(float)
    got = l.segments(spark.createDataFrame(raster(a), SCHEMA)).collect()
    assert len(got) == 4
    sides = set()
    for s in got:
        dx, dy = s.x2 - s.x1, s.y2 - s.y1
        assert 40 < math.hypot(dx, dy) < 60 and s.strength > 10
        mx, my = (s.x1 + s.x2) / 2 - 60, (s.y1 + s.y2) / 2 - 60
        mu, mv = mx * math.cos(turn) + my * math.sin(turn), my * math.cos(turn) - mx * math.sin(turn)
        along = math.degrees(math.atan2(dy, dx) - turn) % 90
        assert min(along, 90 - along) < 3 and abs(max(abs(mu), abs(mv)) - half) < 1.5 and min(abs(mu), abs(mv)) < 3
        sides.add((round(mu / half), round(mv / half)))
    assert len(sides) == 4
    noise = (np.random.default_rng(2).random((80, 80)) < 0.3).astype(float)
    assert l.segments(spark.createDataFrame(raster(noise), SCHEMA)).count() <= 2  # about one false alarm is what the test allows


def test_empty_and_odd(spark):
    assert l.segments(spark.createDataFrame([], SCHEMA)).count() == 0
    assert l.segments(spark.createDataFrame([(0, 0, 1.0), (0, 0, 1.0), (1, 1, None), (None, 2, 1.0), (5, 5, float("nan"))], SCHEMA)).count() == 0
