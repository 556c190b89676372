"""Groups of tiles along a corridor, against a plain loop."""

import math

import numpy as np
import pytest

from spanlight.operators import tiles as t

SCHEMA = "id long, x double, y double, x1 double, y1 double, x2 double, y2 double"


def plain(rows, start, step, ratio):
    left = list(rows)
    _, _, x, y = min((((r[1] - start[0]) ** 2 + (r[2] - start[1]) ** 2), r[0], r[1], r[2]) for r in left)
    at, out, g = (x, y), {}, 0
    while left:
        group, k = [], 1
        while left:
            near = [r for r in left if abs(r[1] - at[0]) <= k * step and abs(r[2] - at[1]) <= k * step]
            group, left, k = group + near, [r for r in left if r not in near], k + 1
            if group:
                w, h = max(r[5] for r in group) - min(r[3] for r in group), max(r[6] for r in group) - min(r[4] for r in group)
                if near and (w * ratio < h or h * ratio < w):
                    break
        out |= {r[0]: g for r in group}
        _, _, x, y = max((((r[1] - at[0]) ** 2 + (r[2] - at[1]) ** 2), r[0], r[1], r[2]) for r in group)
        at, g = (x, y), g + 1
    return out


def corridor(n, seed):
    rng = np.random.default_rng(seed)
    out, at, turn = [], np.zeros(2), 0.2
    for i in range(n):
        turn += rng.normal() * 0.04
        at = at + 10 * np.array([math.cos(turn), math.sin(turn)])
        x, y = at + rng.uniform(-2, 2, 2)
        out.append((i, float(x), float(y), float(x - 5), float(y - 5), float(x + 5), float(y + 5)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_a_plain_loop(spark, seed):
    rows = corridor(40, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["group"] for r in t.tile_groups(df, "id", (-3.0, 1.0), 20.0).collect()}
    assert got == plain(rows, (-3.0, 1.0), 20.0, 3.0) and len(set(got.values())) > 2


def test_directions(spark):
    rows = [(i, 10.0 * i, 100.0, 10.0 * i - 5, 95.0, 10.0 * i + 5, 105.0) for i in range(12)]
    groups = t.tile_groups(spark.createDataFrame(rows, SCHEMA), "id", (200.0, 100.0), 10.0)
    got = sorted(t.group_directions(groups).collect())
    assert sum(g.n for g in got) == 12 and len(got) > 1
    # From the right end on, groups run to the left.
    assert all(abs(g.ux + 1) < 1e-12 and abs(g.uy) < 1e-12 for g in got if g.n > 1)


def test_odd_tiles(spark):
    assert t.tile_groups(spark.createDataFrame([], SCHEMA), "id", (0.0, 0.0), 1.0).count() == 0
    rows = [(1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)] * 2 + [(2, None, 0.0, 0.0, 0.0, 0.0, 0.0)]
    got = t.tile_groups(spark.createDataFrame(rows, SCHEMA), "id", (0.0, 0.0), 1.0)
    assert [(r["id"], r["group"]) for r in got.collect()] == [(1, 0)] * 2
    assert t.group_directions(got).select("ux", "uy").first() == (1.0, 0.0)
