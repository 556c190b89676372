"""Registration of clouds beyond plain closest points: to the target's tangent planes, and sparse (most residuals zero, some large).

The state of a registration is one rotation and one shift on the driver; each step comes from one row of sums. Clouds are worked on around the target's
middle and in units of the larger diagonal, so thresholds mean the same for a tower and for a corridor."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .fits import moved, rigid
from .joins import nearest

T, N = ("tx", "ty", "tz"), ("nx", "ny", "nz")


def normals(df: DataFrame, key: str, k: int = 8, start: float = 1.0) -> DataFrame:
    """key, nx, ny, nz, flatness: the direction in which a point and its k nearest spread least (upwards; of a level one the first part that isn't zero
    is positive) and that spread's share of all, 0 on a plane. Points with fewer than two neighbours, or whose neighbours all lie at one place, have none."""
    at = df.select(F.col(key).alias("b"), "x", "y", "z")
    around = nearest(df, df, k + 1, key, key, start=start).select("a", "b").join(at, "b")
    pairs = [(p, q) for i, p in enumerate("xyz") for q in "xyz"[i:]]
    sums = around.groupBy("a").agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(p, q).alias(p + q) for p, q in pairs]).where("n > 2 AND xx + yy + zz > 0")

    def spread(batches):
        for b in batches:
            m = np.empty((len(b), 3, 3))
            for p, q in pairs:
                m[:, "xyz".index(p), "xyz".index(q)] = m[:, "xyz".index(q), "xyz".index(p)] = b[p + q]
            e, v = np.linalg.eigh(m)
            n = np.where(np.abs(v[:, :, 0]) < 1e-12, 0.0, v[:, :, 0])
            first = np.where(n[:, 2] != 0, n[:, 2], np.where(n[:, 0] != 0, n[:, 0], n[:, 1]))
            n = n * np.where(first < 0, -1.0, 1.0)[:, None]
            yield b[["a"]].rename(columns={"a": key}).assign(nx=n[:, 0], ny=n[:, 1], nz=n[:, 2], flatness=np.maximum(e[:, 0], 0.0) / e.sum(axis=1))

    return sums.mapInPandas(spread, f"{key} {dict(df.dtypes)[key]}, nx double, ny double, nz double, flatness double")


def planar(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The small turn and shift that bring (x, y, z) closest to the planes through (tx, ty, tz) across (nx, ny, nz), with weight w, and the weighted mean of
    squared distances before: six unknowns, whose 6 x 6 system is one row of sums. Directions that the planes leave free stay at rest."""
    x, n = [F.col(c) for c in "xyz"], [F.col(c) for c in N]
    row = [x[1] * n[2] - x[2] * n[1], x[2] * n[0] - x[0] * n[2], x[0] * n[1] - x[1] * n[0], *n]
    gap = sum((n[i] * (F.col(T[i]) - x[i]) for i in range(3)), F.lit(0.0))
    p = pairs.select("w", *[c.alias(f"r{i}") for i, c in enumerate(row)], gap.alias("g"))
    at = [(i, j) for i in range(6) for j in range(i, 6)]
    s = p.agg(F.sum("w").alias("w"), F.sum(F.expr("w * g * g")).alias("e"), *[F.sum(F.expr(f"w * r{i} * g")).alias(f"q{i}") for i in range(6)],
              *[F.sum(F.expr(f"w * r{i} * r{j}")).alias(f"m{i}{j}") for i, j in at]).first()
    if not s["w"]:
        return np.eye(3), np.zeros(3), float("inf")
    m = np.zeros((6, 6))
    for i, j in at:
        m[i, j] = m[j, i] = s[f"m{i}{j}"]
    move = np.linalg.lstsq(m, np.array([s[f"q{i}"] for i in range(6)]), rcond=1e-9)[0]
    return turn(move[:3]), move[3:], s["e"] / s["w"]


def turn(v: np.ndarray) -> np.ndarray:
    """The rotation about v by its length."""
    angle = float(np.linalg.norm(v))
    if angle < 1e-300:
        return np.eye(3)
    a, b, c = v / angle
    k = np.array([[0, -c, b], [c, 0, -a], [-b, a, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


def shrinkage(length: Column, p: float, mu: float) -> Column:
    """The factor by which a residual shrinks that is charged its p-th power, 0 < p < 1, and mu / 2 times the square of its change: none is left below a
    bound, above it the factor is the limit of a contraction, taken three times."""
    base = (2 / mu * (1 - p)) ** (1 / (2 - p))
    bound = base + p / mu * base ** (p - 1)
    size = F.greatest(length, F.lit(bound))
    share = (F.lit(base) / size + 1) / 2
    for _ in range(3):
        share = 1 - F.lit(p / mu) * F.pow(size, F.lit(p - 2)) * F.pow(share, F.lit(p - 1))
    return F.when(length > bound, share).otherwise(F.lit(0.0))


def sparse(pairs: DataFrame, write: Callable[[DataFrame, str], DataFrame], name: str, p: float = 0.4, mu: float = 10.0, growth: float = 3.0, steps: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The motion of (x, y, z) to (tx, ty, tz) with the least sum of p-th powers of the distances. In each step residuals shrink, the points move to what is
    left of them, and multipliers gather what both disagree by; the charge for disagreeing grows. A step is one row of sums and one written table."""
    state = pairs.select("x", "y", "z", *T, *[F.lit(0.0).alias(f"c{c}") for c in "xyz"])
    rotation, shift = np.eye(3), np.zeros(3)
    for i in range(steps):
        h = [F.col(c) - F.col(t) + F.col(f"c{c}") / mu for c, t in zip("xyz", T)]
        part = state.withColumns({f"h{c}": e for c, e in zip("xyz", h)}).withColumn("f", shrinkage(F.expr("sqrt(hx * hx + hy * hy + hz * hz)"), p, mu))
        aim = [F.col(t) + F.col(f"h{c}") * F.col("f") - F.col(f"c{c}") / mu for c, t in zip("xyz", T)]
        part = write(part.withColumns({f"u{c}": e for c, e in zip("xyz", aim)}), f"{name}-{i}")
        r, s, _ = rigid(part.select("x", "y", "z", *[F.col(f"u{c}").alias(t) for c, t in zip("xyz", T)], F.lit(1.0).alias("w")))
        rotation, shift = np.array(r) @ rotation, np.array(r) @ shift + np.array(s)
        after = moved(part, r, s)
        held = {f"c{c}": F.col(f"c{c}") + mu * (F.col(c) - F.col(t) - F.col(f"h{c}") * F.col("f")) for c, t in zip("xyz", T)}
        state = after.withColumns(held).select("x", "y", "z", *T, *held)
        mu *= growth
    return rotation, shift


def aligned(source: DataFrame, target: DataFrame, source_id: str, target_id: str, write: Callable[[DataFrame, str], DataFrame], method: str = "planes", rounds: int = 30,
            neighbours: int = 8, flat: float = 0.1, robust: float | None = None, p: float = 0.4, start: float = 0.02, still: float = 1e-9) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """source moved onto target, the rotation and the shift (x -> rotation x + shift). "planes": each point goes to the tangent plane of its closest target point,
    where the neighbourhood's flatness is at most ``flat``; with ``robust`` (in diagonals) pairs weigh exp(-d² / (2 robust²)), d the distance to the
    plane, so that points beside an edge that meet the wrong plane pull little. "sparse": sums of p-th powers of distances, so that few or many wrong pairs pull nothing. Ends when a round moves nothing by more than ``still`` diagonals.
    An empty source or target, or one without places, leaves the source where it is. Rows with a null or NaN place neither count nor move."""
    whole = lambda df: df.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))
    rotation, shift = np.eye(3), np.zeros(3)
    spans = [whole(df).agg(*[f(c).alias(k + c) for c in "xyz" for k, f in (("l", F.min), ("h", F.max), ("m", F.avg))]).first() for df in (source, target)]
    if any(s["lx"] is None for s in spans):
        return source, rotation, shift
    size = max(float(np.sqrt(sum((s[f"h{c}"] - s[f"l{c}"]) ** 2 for c in "xyz"))) for s in spans) or 1.0
    middle = np.array([spans[1][f"m{c}"] for c in "xyz"])
    small = lambda df, key: moved(whole(df).select(key, "x", "y", "z"), np.eye(3) / size, -middle / size)
    here = write(small(source, source_id), "source")
    there = write(small(target, target_id), "target")
    goal = there.select(F.col(target_id).alias("b"), *[F.col(c).alias(t) for c, t in zip("xyz", T)])
    if method == "planes":
        flats = write(normals(there, target_id, neighbours, start).where(F.col("flatness") <= flat).drop("flatness"), "normals")
        goal = goal.join(flats.withColumnRenamed(target_id, "b"), "b")
    for i in range(rounds):
        at = moved(here, rotation, shift)
        near = nearest(at, there, 1, source_id, target_id, start=start)
        gap = F.expr("nx * (tx - x) + ny * (ty - y) + nz * (tz - z)")
        weight = F.lit(1.0) if robust is None or method != "planes" else F.exp(-gap * gap / (2 * robust * robust))
        pairs = near.select("a", "b").join(at.withColumnRenamed(source_id, "a"), "a").join(goal, "b").withColumn("w", weight)
        r, s = planar(pairs)[:2] if method == "planes" else sparse(pairs, write, f"sparse-{i}", p)
        rotation, shift = r @ rotation, r @ shift + s
        if max(np.abs(r - np.eye(3)).max(), np.abs(s).max()) <= still:
            break
    back = middle + size * shift - rotation @ middle
    return moved(source, rotation, back), rotation, back
