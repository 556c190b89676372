"""Line segments of a raster: neighbouring cells whose level lines run alike grow to regions, a region becomes a rectangle, and a rectangle stays if
so many aligned cells in it are unlikely to meet by chance (the a-contrario test of the published line segment detectors).

Regions are connected components over the edges between alike neighbours, so no growth order and no single task; those too sparse for their rectangle are
parted by narrower angles in rounds."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import scratch, written
from . import graph

TURN = 2 * math.pi


def blurred(raster: DataFrame, times: int = 1) -> DataFrame:
    """cx, cy, value: each time the mean with weights 1, 2, 1 over columns and rows; absent cells are 0."""
    for _ in range(times):
        step = lambda n: F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25))])).alias(n)
        spread = raster.select("cx", "cy", "value", step("i")).select("*", step("j"))
        raster = spread.groupBy((F.col("cx") + F.col("i.d")).alias("cx"), (F.col("cy") + F.col("j.d")).alias("cy")).agg(F.sum(F.col("value") * F.col("i.w") * F.col("j.w")).alias("value"))
    return raster


def level_lines(raster: DataFrame) -> DataFrame:
    """cx, cy, size, angle: of the square of a cell and its right, upper and diagonal neighbours the gradient's size (where not 0) and the direction of its
    level line, with the higher side to the right. One sum: each cell gives its value with a sign to the four squares that it belongs to."""
    part = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("p")
    sign = lambda c: F.when(F.col(f"p.{c}") == 1, F.col("value")).otherwise(-F.col("value")) / 2
    squares = raster.select("cx", "cy", "value", part).groupBy((F.col("cx") - F.col("p.i")).alias("cx"), (F.col("cy") - F.col("p.j")).alias("cy"))
    g = squares.agg(F.sum(sign("i")).alias("gx"), F.sum(sign("j")).alias("gy"))
    return g.select("cx", "cy", F.sqrt(F.expr("gx * gx + gy * gy")).alias("size"), F.atan2("gx", F.expr("0.0D - gy")).alias("angle")).where("size > 0")


def apart(a: Column, b: Column) -> Column:
    """The angle between two directions, 0 to a half turn."""
    d = F.abs(a - b) % TURN
    return F.least(d, TURN - d)


def rectangles(cells: DataFrame) -> DataFrame:
    """Of each region (cells with region, cx, cy, size, angle) its rectangle: mx, my (middle by weights of sizes), ux, uy (main direction, along the level lines),
    t1 to t2 and s1 to s2 (the reach along and across it, half a cell beyond the cells' middles), n, density and angle."""
    w = F.col("size")
    m = cells.groupBy("region").agg((F.sum(w * F.col("cx")) / F.sum(w)).alias("mx"), (F.sum(w * F.col("cy")) / F.sum(w)).alias("my"), F.sum(w).alias("w"), F.atan2(F.sum(F.sin("angle")), F.sum(F.cos("angle"))).alias("mean"))
    at = cells.join(m, "region").withColumn("dx", F.col("cx") - F.col("mx")).withColumn("dy", F.col("cy") - F.col("my"))
    second = at.groupBy("region").agg(F.sum(F.expr("size * dx * dx")).alias("xx"), F.sum(F.expr("size * dy * dy")).alias("yy"), F.sum(F.expr("size * dx * dy")).alias("xy"))
    axis = second.select("region", (F.atan2(F.expr("2 * xy"), F.expr("xx - yy")) / 2).alias("axis"))
    at = at.join(axis, "region")
    angle = F.when(apart(F.col("axis"), F.col("mean")) > math.pi / 2, F.col("axis") + math.pi).otherwise(F.col("axis"))
    at = at.withColumn("turn", angle).withColumns({"t": F.expr("dx * cos(turn) + dy * sin(turn)"), "s": F.expr("dy * cos(turn) - dx * sin(turn)")})
    ends = at.groupBy("region").agg(*[F.first(c).alias(c) for c in ("mx", "my", "turn")], *[(f(c) + d).alias(c + k) for c in "ts" for k, f, d in (("1", F.min, -0.5), ("2", F.max, 0.5))], F.count(F.lit(1)).alias("n"))
    return ends.select("region", "mx", "my", "turn", F.cos("turn").alias("ux"), F.sin("turn").alias("uy"), "t1", "t2", "s1", "s2", "n", (F.col("n") / ((F.col("t2") - F.col("t1")) * (F.col("s2") - F.col("s1")))).alias("density"))


def covered(boxes: DataFrame) -> DataFrame:
    """region, cx, cy of all cells whose middle a rectangle covers: row by row, the columns between its four sides, so work is its area, not its bounds'."""
    corner = [(F.col("mx") + F.col(t) * F.col("ux") - F.col(s) * F.col("uy"), F.col("my") + F.col(t) * F.col("uy") + F.col(s) * F.col("ux")) for t in ("t1", "t2") for s in ("s1", "s2")]
    rows = boxes.withColumn("cy", F.explode(F.sequence(F.ceil(F.least(*[c[1] for c in corner])), F.floor(F.greatest(*[c[1] for c in corner])))))
    dy = F.col("cy") - F.col("my")

    def between(low, high, u, rest):
        # low <= dx * u + rest <= high
        a, b = (low - rest) / u, (high - rest) / u
        flat = F.abs(u) < 1e-12
        inside = (rest >= low) & (rest <= high)
        return F.when(flat, F.when(inside, F.lit(-1e15)).otherwise(F.lit(1e15))).otherwise(F.least(a, b)), F.when(flat, F.when(inside, F.lit(1e15)).otherwise(F.lit(-1e15))).otherwise(F.greatest(a, b))

    along = between(F.col("t1"), F.col("t2"), F.col("ux"), dy * F.col("uy"))
    across = between(F.col("s1"), F.col("s2"), -F.col("uy"), dy * F.col("ux"))
    span = rows.withColumn("c1", F.ceil(F.col("mx") + F.greatest(along[0], across[0]))).withColumn("c2", F.floor(F.col("mx") + F.least(along[1], across[1]))).where("c1 <= c2")
    return span.select("region", "cy", F.explode(F.sequence("c1", "c2")).alias("cx")).select("region", "cx", "cy")


def log_tail(n: int, k: int, p: float) -> float:
    """The decimal logarithm of the chance of k or more hits in n trials with chance p."""
    if k <= 0:
        return 0.0
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, part, i = 1.0, 1.0, k
    while i < n and (part > 1e-14 * total or i < n * p):
        part *= (n - i) / (i + 1) * p / (1 - p)
        total, i = total + part, i + 1
        if total > 1e200:
            term, part, total = term + math.log(total), part / total, 1.0
    return min((term + math.log(total)) / math.log(10), 0.0)


def segments(raster: DataFrame, blur: int = 2, tolerance: float = 22.5, least: float = 0.02, density: float = 0.7, rounds: int = 4, chance: float = 1.0) -> DataFrame:
    """x1, y1, x2, y2 (cell units; the middle of cell (0, 0) is (0, 0)), width, n, aligned, strength (minus the decimal logarithm of the number of false alarms; kept
    where that number is at most ``chance``) of the segments of a raster (cx, cy, value). tolerance in degrees; gradients of less than ``least`` have no direction.
    Sparse regions (under ``density`` of their rectangle) are parted where angles differ from their mean by the tolerance, twice, then by half and a quarter of it, for ``rounds`` rounds; what is still
    sparse has no line, as the published detectors decide too. Cells with a null or NaN value count as 0; an empty raster has no segments."""
    spark = raster.sparkSession
    base = scratch(spark, "segments")
    clean = raster.where("cx IS NOT NULL AND cy IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)").groupBy("cx", "cy").agg(F.max("value").cast("double").alias("value"))
    lines = level_lines(blurred(clean, blur)).where(F.col("size") > least).select(F.col("cx").cast("long"), F.col("cy").cast("long"), "size", "angle")
    lines = written(lines, base, "lines")
    bounds = lines.agg(*[(F.max(c) - F.min(c) + 1).alias(c) for c in ("cx", "cy")]).first()
    tests = 2.5 * math.log10(max((bounds["cx"] or 1) * (bounds["cy"] or 1), 1)) + math.log10(11)
    share = tolerance / 180
    smallest = max(2, math.floor(-tests / math.log10(share)))
    grid, found = graph.Grid.of(lines, ("cx", "cy")), None
    left = lines.withColumns({"part": F.lit(0).cast("long"), "id": grid.id()})
    for i in range(rounds + 1):
        alike = (apart(F.col("angle"), F.col("n_angle")) <= math.radians(tolerance)) & (F.col("part") == F.col("n_part"))
        parts = graph.components(left.select("id"), graph.cell_edges(left, grid, alike, ("angle", "part"))).withColumnRenamed("component", "region")
        cells = left.join(parts, "id")
        large = cells.groupBy("region").count().where(F.col("count") >= smallest).select("region")
        cells = written(cells.join(large, "region", "left_semi"), base, f"cells-{i}")
        boxes = written(rectangles(cells), base, f"boxes-{i}")
        dense = boxes.where(F.col("density") >= density).withColumn("region", F.concat_ws(":", F.lit(i), "region"))
        found = dense if found is None else found.unionByName(dense)
        thin = boxes.where(F.col("density") < density).select("region")
        if i == rounds or thin.isEmpty():
            break
        limit = math.radians(tolerance) / 2 ** max(i - 1, 0)
        open_ = cells.join(thin, "region", "left_semi")
        mean = open_.groupBy("region").agg(F.atan2(F.sum(F.sin("angle")), F.sum(F.cos("angle"))).alias("mean"))
        off = (F.col("angle") - F.col("mean") + 3 * math.pi) % TURN - math.pi
        side = F.when(off > limit, 2).when(off < -limit, 1).otherwise(0)
        left = written(open_.join(mean, "region").withColumn("part", F.col("region") * 3 + side).select("cx", "cy", "size", "angle", "part", "id"), base, f"left-{i}")
    found = written(found, base, "found")
    hits = covered(found).join(found.select("region", "turn"), "region").join(lines.select("cx", "cy", "angle"), ["cx", "cy"], "left")
    counts = hits.groupBy("region").agg(F.count(F.lit(1)).alias("trials"), F.count_if(apart(F.col("angle"), F.col("turn")) <= math.radians(tolerance)).alias("aligned"))

    @F.pandas_udf("double")
    def strength(n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([-tests - log_tail(int(a), int(b), share) for a, b in zip(n, k)])

    kept = found.join(counts, "region").withColumn("strength", strength("trials", "aligned")).where(F.col("strength") >= -math.log10(chance))
    # A square of four cells has its middle half a cell off; so has the rectangle.
    side = (F.col("s1") + F.col("s2")) / 2
    end = lambda t: ((F.col("mx") + F.col(t) * F.col("ux") - side * F.col("uy") + 0.5), (F.col("my") + F.col(t) * F.col("uy") + side * F.col("ux") + 0.5))
    (x1, y1), (x2, y2) = end("t1"), end("t2")
    return kept.select(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), (F.col("s2") - F.col("s1")).alias("width"), "n", "aligned", "strength")
