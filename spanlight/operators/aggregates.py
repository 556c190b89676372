"""Aggregates over point relations: bounding boxes, voxels, histograms, robust extremes, covariance features, densities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import scratch, written


def bounds(df: DataFrame, *by: str) -> DataFrame:
    """Bounding box of all points or of each group."""
    return df.groupBy(*by).agg(*[f(c).alias(f"{n}{c}") for n, f in (("min_", F.min), ("max_", F.max)) for c in "xyz"])


def voxel(size: float, dims: str = "xyz") -> list[Column]:
    return [F.floor(F.col(c) / F.lit(float(size))).alias(f"v{c}") for c in dims]


def voxel_centroids(df: DataFrame, size: float, *more: Column) -> DataFrame:
    """One point for each occupied voxel: the mean of its points."""
    return df.groupBy(*voxel(size)).agg(*[F.avg(c).alias(c) for c in "xyz"], *more)


def clamped_cell(v: Column, low: Column | float, size: float, n: int) -> Column:
    """Cell index with points beyond the edges in the edge cells."""
    return F.greatest(F.lit(0), F.least(F.floor((v - low) / F.lit(float(size))), F.lit(n - 1)))


def robust_extremes(df: DataFrame, column: str, step: float, min_points: int, *by: str) -> DataFrame:
    """low and high of a column over the bins of width step, counted from its minimum, from the first to the last bin with more than
    min_points; no row if fewer than two such bins."""
    v = F.col(column)
    start = df.groupBy(*by).agg(F.min(column).alias("_start"))
    placed = (df.join(start, list(by)) if by else df.crossJoin(F.broadcast(start))).withColumn("_bin", F.floor((v - F.col("_start")) / F.lit(float(step))))
    bins = placed.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).where(F.col("n") > min_points)
    ends = bins.groupBy(*by).agg(F.min("_bin").alias("i"), F.max("_bin").alias("j"), F.min_by("lo", "_bin").alias("low"), F.max_by("hi", "_bin").alias("high"))
    return ends.where("i < j").select(*by, "low", "high")


def covariance(df: DataFrame, *by: str) -> DataFrame:
    """Centroid and population covariance of each group."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])


def eigenvalues(cov: DataFrame) -> DataFrame:
    """covariance rows -> also l1 >= l2 >= l3, by the closed form for symmetric matrices."""
    c = {k: F.col(f"c{k}") for k in ("xx", "yy", "zz", "xy", "xz", "yz")}
    off = c["xy"] * c["xy"] + c["xz"] * c["xz"] + c["yz"] * c["yz"]
    q = (c["xx"] + c["yy"] + c["zz"]) / 3
    spread = (c["xx"] - q) * (c["xx"] - q) + (c["yy"] - q) * (c["yy"] - q) + (c["zz"] - q) * (c["zz"] - q) + 2 * off
    p = F.sqrt(spread / 6)
    a, b, d = [(c[k] - q) / F.nullif(p, F.lit(0.0)) for k in ("xx", "yy", "zz")]
    e, f, g = [c[k] / F.nullif(p, F.lit(0.0)) for k in ("xy", "xz", "yz")]
    det = a * (b * d - g * g) - e * (e * d - g * f) + f * (e * g - b * f)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    out = cov.withColumn("_q", q).withColumn("_p", p).withColumn("_angle", angle)
    l1 = F.coalesce(F.col("_q") + 2 * F.col("_p") * F.cos("_angle"), F.col("_q"))
    l3 = F.coalesce(F.col("_q") + 2 * F.col("_p") * F.cos(F.col("_angle") + F.lit(2 * math.pi / 3)), F.col("_q"))
    return out.withColumn("l1", l1).withColumn("l3", l3).withColumn("l2", 3 * F.col("_q") - F.col("l1") - F.col("l3")).drop("_q", "_p", "_angle")


def shape_features(eig: DataFrame) -> DataFrame:
    """linearity (l1 - l2) / l1 and sphericity l3 / l1, 0 where l1 is."""
    flat = F.col("l1") == 0
    return eig.withColumn("linearity", F.when(flat, 0.0).otherwise((F.col("l1") - F.col("l2")) / F.col("l1"))).withColumn("sphericity", F.when(flat, 0.0).otherwise(F.col("l3") / F.col("l1")))


def plane_axis(df: DataFrame, *by: str) -> DataFrame:
    """Main direction in the plane of each group: ux, uy (ux >= 0), closed form."""
    m = df.groupBy(*by).agg(F.covar_pop("x", "x").alias("a"), F.covar_pop("x", "y").alias("b"), F.covar_pop("y", "y").alias("d"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    t = F.atan2(2 * F.col("b"), F.col("a") - F.col("d")) / 2
    return m.select(*by, "mx", "my", F.cos(t).alias("ux"), F.sin(t).alias("uy"))


def parabola_fit(df: DataFrame, *by: str, y: str = "y", z: str = "z") -> DataFrame:
    """Least squares z = a y² + b y + c of each group from moment sums about the mean of y; nulls for under three different y."""
    mean = df.groupBy(*by).agg(F.avg(y).alias("_m"))
    t = (df.join(mean, list(by)) if by else df.crossJoin(F.broadcast(mean))).withColumn("_t", F.col(y) - F.col("_m"))
    s = t.groupBy(*by).agg(F.first("_m").alias("m"), F.count(F.lit(1)).alias("n"), *[F.sum(F.pow("_t", F.lit(float(k)))).alias(f"s{k}") for k in (1, 2, 3, 4)], *[F.sum(F.pow("_t", F.lit(float(k))) * F.col(z)).alias(f"q{k}") for k in (0, 1, 2)])
    n, s1, s2, s3, s4, q0, q1, q2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "q0", "q1", "q2"))
    det = s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2)
    a = (q2 * (s2 * n - s1 * s1) - s3 * (q1 * n - s1 * q0) + s2 * (q1 * s1 - s2 * q0)) / F.nullif(det, F.lit(0.0))
    b = (s4 * (q1 * n - s1 * q0) - q2 * (s3 * n - s1 * s2) + s2 * (s3 * q0 - q1 * s2)) / F.nullif(det, F.lit(0.0))
    c = (s4 * (s2 * q0 - q1 * s1) - s3 * (s3 * q0 - q1 * s2) + q2 * (s3 * s1 - s2 * s2)) / F.nullif(det, F.lit(0.0))
    out = s.withColumn("_a", a).withColumn("_b", b).withColumn("_c", c)
    m = F.col("m")
    return out.select(*by, "n", F.col("_a").alias("a"), (F.col("_b") - 2 * F.col("_a") * m).alias("b"), (F.col("_a") * m * m - F.col("_b") * m + F.col("_c")).alias("c"))


def robust_parabola(df: DataFrame, by: str, scale: float = 0.5, rounds: int = 30) -> DataFrame:
    """z = a y² + b y + c of each group under the Cauchy loss, by iteratively reweighted least squares: a round is one join of points to their group's
    curve and one row of weighted moments a group, so groups may be of any size. Curves of a round are written. Groups of under three different y have nulls."""
    base = scratch(df.sparkSession, "robust")
    mean = df.groupBy(by).agg(F.avg("y").alias("m"))
    rows = written(df.select(by, "y", "z").join(mean, by).select(by, "m", (F.col("y") - F.col("m")).alias("t"), "z"), base, "rows")
    t, z = F.col("t"), F.col("z")
    curve = None
    for i in range(rounds):
        if curve is None:
            weighted = rows.withColumn("w", F.lit(1.0))
        else:
            off = (F.col("a") * t * t + F.col("b") * t + F.col("c") - z) / scale
            weighted = rows.join(curve.select(by, "a", "b", "c"), by).withColumn("w", F.coalesce(1 / (1 + off * off), F.lit(1.0)))
        w = F.col("w")
        sums = weighted.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.first("m").alias("m"), *[F.sum(w * F.pow(t, F.lit(float(k)))).alias(f"s{k}") for k in range(5)], *[F.sum(w * F.pow(t, F.lit(float(k))) * z).alias(f"q{k}") for k in range(3)])
        s0, s1, s2, s3, s4, q0, q1, q2 = (F.col(x) for x in ("s0", "s1", "s2", "s3", "s4", "q0", "q1", "q2"))
        det = F.nullif(s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2), F.lit(0.0))
        a = (q2 * (s2 * s0 - s1 * s1) - s3 * (q1 * s0 - s1 * q0) + s2 * (q1 * s1 - s2 * q0)) / det
        b = (s4 * (q1 * s0 - s1 * q0) - q2 * (s3 * s0 - s1 * s2) + s2 * (s3 * q0 - q1 * s2)) / det
        c = (s4 * (s2 * q0 - q1 * s1) - s3 * (s3 * q0 - q1 * s2) + q2 * (s3 * s1 - s2 * s2)) / det
        curve = written(sums.select(by, "n", "m", a.alias("a"), b.alias("b"), c.alias("c")), base, f"curve-{i}")
    m = F.col("m")
    return curve.select(by, "n", "a", (F.col("b") - 2 * F.col("a") * m).alias("b"), (F.col("a") * m * m - F.col("b") * m + F.col("c")).alias("c"))


def fill_rate(df: DataFrame, axis: str, step: float, *by: str) -> DataFrame:
    """Share of the bins along an axis that hold points."""
    low = df.groupBy(*by).agg(F.min(axis).alias("_low"), F.max(axis).alias("_high"))
    placed = df.join(low, list(by)) if by else df.crossJoin(F.broadcast(low))
    bins = placed.groupBy(*by).agg(F.count_distinct(F.floor((F.col(axis) - F.col("_low")) / step)).alias("hit"), (F.floor((F.first("_high") - F.first("_low")) / step) + 1).alias("all"))
    return bins.select(*by, (F.col("hit") / F.col("all")).alias("fill"))


def occupied_area(df: DataFrame, size: float, *by: str) -> DataFrame:
    """Area of the occupied cells of each group."""
    return df.groupBy(*by).agg((F.count_distinct(F.floor(F.col("x") / size), F.floor(F.col("y") / size)) * F.lit(size * size)).alias("area"))


def density(df: DataFrame, area: float) -> DataFrame:
    """Points per area (0 without area), and the difference of heights."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), (n / F.lit(area) if area > 0 else F.lit(0.0)).alias("density"), (F.max("z") - F.min("z")).alias("dz")).where("n > 0")


def tree_metrics(df: DataFrame, by: str, size: float = 0.5) -> DataFrame:
    """Position and height of the top, crown size (diagonal of the XY box) and area (occupied cells) of each tree."""
    dx, dy = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    return df.groupBy(by).agg(F.max("z").alias("top_z"), F.max("hag").alias("height"), F.sqrt(dx * dx + dy * dy).alias("crown_size"), (F.count_distinct(F.floor(F.col("x") / size), F.floor(F.col("y") / size)) * F.lit(size * size)).alias("crown_area"))


def slices(df: DataFrame, step: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """layer by height; below low dropped, from high on a layer of its own (-1)."""
    out = df if low is None else df.where(F.col("z") >= low)
    layer = F.floor((F.col("z") - F.lit(low or 0.0)) / F.lit(float(step)))
    return out.withColumn("layer", layer if high is None else F.when(F.col("z") >= high, F.lit(-1)).otherwise(layer))


def pole_layers(df: DataFrame, by: str, step: float, cell: float, most_area: float, least_fill: float) -> DataFrame:
    """by, layer, area, height of the layers of each group that are narrow (occupied area below ``most_area``) and filled over ``least_fill`` of a step."""
    layers = df.groupBy(by, F.floor(F.col("z") / step).alias("layer")).agg((F.count_distinct(F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)) * F.lit(cell * cell)).alias("area"), (F.max("z") - F.min("z")).alias("height"))
    return layers.where((F.col("area") < most_area) & (F.col("height") > least_fill * step))
