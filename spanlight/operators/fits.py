"""Fits of curves, planes and lines to groups of points: moments are summed by Spark, so no group is gathered in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import scratch, written
from .aggregates import parabola_fit, plane_axis
from .classify import sampled_curve

#: Groups of more points are few, so their hypotheses go to all tasks; all their points by one key would be one task.
GROUP_POINTS = 100_000


def polynomial_fit(df: DataFrame, by: str, degree: int = 7, y: str = "y", z: str = "z") -> DataFrame:
    """by, n, middle, half, coefficients (of ((y - middle) / half) ** k, from k = 0) of each group's least-squares polynomial, by its moments; a group of
    too few different y gets the shortest solution. A group's moments are 3 degree + 2 numbers, which are solved row by row."""
    import numpy as np
    import pyarrow as pa

    box = df.groupBy(by).agg(((F.max(y) + F.min(y)) / 2).alias("_m"), F.greatest((F.max(y) - F.min(y)) / 2, F.lit(1e-12)).alias("_h"))
    t = df.join(box, by).withColumn("_t", (F.col(y) - F.col("_m")) / F.col("_h"))
    powers = [F.sum(F.pow("_t", F.lit(float(k)))) for k in range(2 * degree + 1)]
    heights = [F.sum(F.pow("_t", F.lit(float(k))) * F.col(z)) for k in range(degree + 1)]
    sums = t.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.first("_m").alias("middle"), F.first("_h").alias("half"), F.array(*powers).alias("s"), F.array(*heights).alias("q"))

    def solve(batches):
        at = np.add.outer(np.arange(degree + 1), np.arange(degree + 1))
        for batch in batches:
            c = [np.linalg.lstsq(np.array(s)[at], np.array(q), rcond=None)[0].tolist() for s, q in zip(batch.column("s").to_pylist(), batch.column("q").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (by, "n", "middle", "half")), pa.array(c, pa.list_(pa.float64()))], names=[by, "n", "middle", "half", "coefficients"])

    return sums.mapInArrow(solve, f"{by} {dict(df.dtypes)[by]}, n long, middle double, half double, coefficients array<double>")


def polynomial_at(y: Column) -> Column:
    """The value of a fitted polynomial (its columns beside y), by Horner's rule."""
    t = (y - F.col("middle")) / F.col("half")
    return F.aggregate(F.reverse("coefficients"), F.lit(0.0), lambda s, c: s * t + c)


def wire_fit(df: DataFrame, *by: str) -> DataFrame:
    """The vertical parabola of each wire: main direction in the plane (ux, uy through mx, my), z = a t² + b t + c along it, and the range of t."""
    t = df.join(plane_axis(df, *by), list(by)).withColumn("t", (F.col("x") - F.col("mx")) * F.col("ux") + (F.col("y") - F.col("my")) * F.col("uy"))
    ends = t.groupBy(*by).agg(F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("ux").alias("ux"), F.first("uy").alias("uy"), F.min("t").alias("t1"), F.max("t").alias("t2"))
    return parabola_fit(t, *by, y="t").join(ends, list(by))


def extended(fits: DataFrame, low: Column, high: Column, most: float) -> DataFrame:
    """Wire fits prolonged to the places low and high along them, by up to ``most`` at each end."""
    return fits.withColumn("t1", F.greatest(F.least("t1", low), F.col("t1") - most)).withColumn("t2", F.least(F.greatest("t2", high), F.col("t2") + most))


def wire_points(fits: DataFrame, step: float) -> DataFrame:
    """Places along fitted wires: the fits' columns but t1, t2 with x, y, z."""
    rows = sampled_curve(fits.withColumnRenamed("t1", "y_min").withColumnRenamed("t2", "y_max"), step).withColumnRenamed("y", "t")
    return rows.withColumn("x", F.col("mx") + F.col("t") * F.col("ux")).withColumn("y", F.col("my") + F.col("t") * F.col("uy")).drop("y_min", "y_max")


def wire_distance(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Beside a wire fit's columns: place along it, distance across it in the plane, and height above it."""
    t = (x - F.col("mx")) * F.col("ux") + (y - F.col("my")) * F.col("uy")
    across = (y - F.col("my")) * F.col("ux") - (x - F.col("mx")) * F.col("uy")
    return t, across, z - (F.col("a") * t * t + F.col("b") * t + F.col("c"))


def picks(df: DataFrame, by: str, key: Sequence[str], tries: int, parts: int, round_: int) -> DataFrame:
    """by, try, n (points of the group) and p0, p1, ... (structs of coordinates): for each try one point of each of ``parts`` hash classes, that with the least hash; hypotheses of a
    sample consensus that come out the same in every run. Groups that lack a class in a try have none there. Hashes count by their first 60 bits: numbers of fixed width are
    aggregated in place, where texts and structs would have all tries of all points sorted."""
    text = F.concat_ws("|", F.lit(str(round_)), F.col("try").cast("string"), *[F.col(k).cast("string") for k in key])
    tried = df.select(*dict.fromkeys([by, "x", "y", "z", *key])).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("_h", F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"))
    of = [F.when(F.shiftright("_h", 44) % parts == i, F.col("_h")) for i in range(parts)]
    at = [F.when(F.count(h) > 0, F.struct(*[F.min_by(c, h).alias(c) for c in "xyz"])).alias(f"p{i}") for i, h in enumerate(of)]
    return tried.groupBy(by, "try").agg(F.count(F.lit(1)).alias("n"), *at).where(" AND ".join(f"p{i} IS NOT NULL" for i in range(parts)))


def met(df: DataFrame, table: DataFrame, by: str) -> DataFrame:
    """df joined to the rows of a stored table of its groups, with n, their number of points."""
    many = F.col("n") > GROUP_POINTS
    few = df.join(F.broadcast(table.where(many).select(by).distinct()), by, "left_anti").join(table.where(~many), by)
    return df.join(F.broadcast(table.where(many)), by).unionByName(few).drop("n")


def best_planes(df: DataFrame, by: str, key: Sequence[str], within: float, tries: int = 20, round_: int = 0) -> DataFrame:
    """by, nx, ny, nz, d, inliers: of each group the plane n · p = d through three points that has the most points within a distance (ties: the first try)."""
    h = picks(df, by, key, tries, 3, round_)
    u, v = ([F.col(f"{p}.{c}") - F.col(f"p0.{c}") for c in "xyz"] for p in ("p1", "p2"))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    h = h.select(by, "try", "n", *[c.alias(k) for c, k in zip(n, ("nx", "ny", "nz"))], "p0")
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    h = h.withColumn("_s", size).where("_s > 0").withColumns({k: F.col(k) / F.col("_s") for k in ("nx", "ny", "nz")})
    h = h.withColumn("d", F.col("nx") * F.col("p0.x") + F.col("ny") * F.col("p0.y") + F.col("nz") * F.col("p0.z")).drop("p0", "_s")
    h = written(h, scratch(df.sparkSession, "tries"), "planes")
    near = F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") - F.col("d")) <= within
    scores = met(df.select(by, "x", "y", "z"), h, by).groupBy(by, "try").agg(F.count_if(near).alias("inliers"))
    first = scores.groupBy(by).agg(F.max(F.struct("inliers", (-F.col("try")).alias("t"))).alias("m")).select(by, F.col("m.inliers").alias("inliers"), (-F.col("m.t")).alias("try"))
    return first.join(h, [by, "try"]).select(by, "nx", "ny", "nz", "d", "inliers")


def planes(df: DataFrame, by: str, key: Sequence[str], within: float, least: int, rounds: int, write, tries: int = 20) -> DataFrame:
    """by, round, plane and inliers: planes taken off one after the other while a group has more than ``least`` points left; each round is written."""
    left, found = df, None
    for i in range(rounds):
        alive = left.groupBy(by).count().where(F.col("count") > least).select(by)
        best = write(best_planes(left.join(alive, by, "left_semi"), by, key, within, tries, i).withColumn("round", F.lit(i)), f"planes-{i}")
        found = best if found is None else found.unionByName(best)
        if best.isEmpty():
            break
        on = F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") - F.col("d")) <= within
        left = write(left.join(best.select(by, "nx", "ny", "nz", "d"), by).where(~on).select(*df.columns), f"left-{i}")
    return found


def best_lines(df: DataFrame, by: str, key: Sequence[str], within: float, tries: int = 20) -> DataFrame:
    """by, mx, my, ux, uy, inliers: of each group the line in the plane through two points with the most points within a distance, refined to the main
    direction of those."""
    h = picks(df, by, key, tries, 2, 0)
    dx, dy = F.col("p1.x") - F.col("p0.x"), F.col("p1.y") - F.col("p0.y")
    size = F.sqrt(dx * dx + dy * dy)
    h = h.where(size > 0).select(by, "try", "n", (dx / size).alias("ux"), (dy / size).alias("uy"), F.col("p0.x").alias("mx"), F.col("p0.y").alias("my"))
    h = written(h, scratch(df.sparkSession, "tries"), "lines")
    near = F.abs((F.col("y") - F.col("my")) * F.col("ux") - (F.col("x") - F.col("mx")) * F.col("uy")) <= within
    scores = met(df.select(by, "x", "y"), h, by).groupBy(by, "try").agg(F.count_if(near).alias("inliers"))
    first = scores.groupBy(by).agg(F.max(F.struct("inliers", (-F.col("try")).alias("t"))).alias("m")).select(by, F.col("m.inliers").alias("inliers"), (-F.col("m.t")).alias("try"))
    best = written(first.join(h, [by, "try"]).drop("try"), scratch(df.sparkSession, "tries"), "best")
    on = met(df.select(by, "x", "y"), best, by).where(near).select(by, "inliers", "x", "y")
    return plane_axis(on, by).join(best.select(by, "inliers"), by)


def rigid(pairs: DataFrame) -> tuple[list[list[float]], list[float], float]:
    """The rotation and shift that take (x, y, z) closest to (tx, ty, tz), with weight w, and the weighted mean of squared distances before; from one row of sums."""
    import numpy as np

    w, p, q = F.col("w"), "xyz", ("tx", "ty", "tz")
    sums = pairs.agg(F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(f"p{c}") for c in p], *[F.sum(w * F.col(c)).alias(f"q{c}") for c in q],
                     *[F.sum(w * F.col(a) * F.col(b)).alias(f"m{a}{b}") for a in p for b in q], F.sum(w * sum(((F.col(a) - F.col(b)) ** 2 for a, b in zip(p, q)), F.lit(0.0))).alias("e")).first()
    total = sums["w"]
    mp, mq = np.array([sums[f"p{c}"] for c in p]) / total, np.array([sums[f"q{c}"] for c in q]) / total
    cross = np.array([[sums[f"m{a}{b}"] for b in q] for a in p]) / total - np.outer(mp, mq)
    u, _, vt = np.linalg.svd(cross)
    r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    return r.tolist(), (mq - r @ mp).tolist(), sums["e"] / total


def moved(df: DataFrame, rotation, shift) -> DataFrame:
    at = [sum((F.col(c) * float(v) for c, v in zip("xyz", row)), F.lit(float(s))) for row, s in zip(rotation, shift)]
    return df.withColumns(dict(zip("xyz", at)))


def registered(source: DataFrame, target: DataFrame, source_id: str, target_id: str, write, rounds: int = 20, start: float = 0.1, robust: float | None = None, tolerance: float = 1e-9) -> tuple[DataFrame, float]:
    """source moved onto target by iterated closest points, and the last mean of squared distances. With ``robust`` pairs weigh exp(-d² / (2 robust²))
    (Welsch). Each round is one nearest-neighbour join and one row of sums; moved points are written."""
    at, before = write(source, "moved"), float("inf")
    goal = target.select(F.col(target_id).alias("b"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    from .joins import nearest

    for i in range(rounds):
        near = nearest(at, target, 1, source_id, target_id, start=start)
        weight = F.lit(1.0) if robust is None else F.exp(-F.col("d2") / (2 * robust * robust))
        pairs = near.select("a", "b", weight.alias("w")).join(at.withColumnRenamed(source_id, "a"), "a").join(goal, "b")
        rotation, shift, error = rigid(pairs)
        if not error < before - tolerance:
            break
        at, before = write(moved(at, rotation, shift), f"moved-{i}"), error
    return at, before
