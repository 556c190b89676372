"""Rasters as long tables of occupied cells (cx, cy[, value]): morphology, hulls, lines, pseudo-colours. Absent cells are empty."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import removed, scratch, written
from . import graph


def dilated(mask: DataFrame, width: int, height: int | None = None) -> DataFrame:
    """Cells under a rectangle around a cell of the mask; even sizes are anchored at half their size."""
    height = height or width
    span = lambda n: F.explode(F.sequence(F.lit(-(n // 2)), F.lit(n - 1 - n // 2)))
    moved = mask.select("cx", "cy").withColumn("ox", span(width)).withColumn("oy", span(height))
    return moved.select((F.col("cx") - F.col("ox")).alias("cx"), (F.col("cy") - F.col("oy")).alias("cy")).distinct()


def eroded(mask: DataFrame, width: int, height: int | None = None) -> DataFrame:
    """Cells whose rectangle is full."""
    height = height or width
    span = lambda n: F.explode(F.sequence(F.lit(-(n // 2)), F.lit(n - 1 - n // 2)))
    moved = mask.select("cx", "cy").distinct().withColumn("ox", span(width)).withColumn("oy", span(height))
    hits = moved.groupBy((F.col("cx") - F.col("ox")).alias("cx"), (F.col("cy") - F.col("oy")).alias("cy")).count()
    return hits.where(F.col("count") == width * height).select("cx", "cy")


def opened(mask: DataFrame, size: int) -> DataFrame:
    return dilated(eroded(mask, size), size)


def closed(mask: DataFrame, size: int) -> DataFrame:
    return eroded(dilated(mask, size), size)


def morphed_points(df: DataFrame, size: float, k: int) -> DataFrame:
    """Points whose cell survives opening and then dilating with a k x k rectangle."""
    placed = df.withColumn("cx", F.floor(F.col("x") / F.lit(float(size)))).withColumn("cy", F.floor(F.col("y") / F.lit(float(size))))
    keep = dilated(opened(placed.select("cx", "cy").distinct(), k), k)
    return placed.join(keep, ["cx", "cy"], "left_semi").drop("cx", "cy")


def labelled(mask: DataFrame) -> DataFrame:
    """cx, cy, component: 8-connected."""
    grid = graph.Grid.of(mask, ("cx", "cy"))
    placed = mask.select("cx", "cy").distinct().withColumn("id", grid.id())
    return placed.join(graph.components(placed.select("id"), graph.cell_edges(placed, grid)), "id").drop("id")


def without_small(mask: DataFrame, size: float, least_area: float) -> DataFrame:
    """Components of at least an area."""
    l = labelled(mask)
    big = l.groupBy("component").count().where(F.col("count") * size * size >= least_area)
    return l.join(big.select("component"), "component", "left_semi").select("cx", "cy")


def touching(mask: DataFrame, other: DataFrame) -> DataFrame:
    """Components of the mask that share a cell with another one."""
    l = labelled(mask)
    hit = l.join(other.select("cx", "cy"), ["cx", "cy"], "left_semi").select("component").distinct()
    return l.join(hit, "component", "left_semi").select("cx", "cy")


def hough(mask: DataFrame, steps: int = 180, width: float = 1.0) -> DataFrame:
    """Votes of the cells for lines x cos t + y sin t = rho, by t (in steps of a half turn) and rho."""
    t = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t")
    rho = F.floor((F.col("cx") * F.cos(F.col("t") * math.pi / steps) + F.col("cy") * F.sin(F.col("t") * math.pi / steps)) / F.lit(width) + 0.5)
    return mask.select("cx", "cy", t).groupBy("t", rho.alias("rho")).agg(F.count(F.lit(1)).alias("votes"))


def shapeness(mask: DataFrame) -> DataFrame:
    """component, area, perimeter (cell sides without a neighbour) and perimeter² / area of each component."""
    l = labelled(mask)
    side = F.explode(F.array(*[F.struct(F.lit(x).alias("ox"), F.lit(y).alias("oy")) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("o")
    sides = l.select("component", "cx", "cy", side).select("component", (F.col("cx") + F.col("o.ox")).alias("cx"), (F.col("cy") + F.col("o.oy")).alias("cy"))
    free = sides.join(l.select("cx", "cy"), ["cx", "cy"], "left_anti").groupBy("component").agg(F.count(F.lit(1)).alias("perimeter"))
    return l.groupBy("component").agg(F.count(F.lit(1)).alias("area")).join(free, "component").withColumn("shapeness", F.col("perimeter") * F.col("perimeter") / F.col("area"))


def pseudo_colour(value: Column, low: float, high: float) -> Column:
    """Struct r, g, b: blue over green to red."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.lit(high - low)))
    byte = lambda v: F.round(F.greatest(F.lit(0.0), v) * 255).cast("int")
    return F.struct(byte(2 * t - 1).alias("r"), byte(1 - F.abs(2 * t - 1)).alias("g"), byte(1 - 2 * t).alias("b"))


def road_mask(roads: DataFrame, size: float, reach: float) -> DataFrame:
    """Cells within reach of a road's segments (x1, y1, x2, y2); candidates are the cells of each segment's widened box."""
    from ..functions.geometry import squared_segment_distance

    grid = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - reach) / size), F.floor((F.greatest(a, b) + reach) / size)))
    near = roads.withColumn("cx", grid(F.col("x1"), F.col("x2"))).withColumn("cy", grid(F.col("y1"), F.col("y2")))
    d2 = squared_segment_distance((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return near.where(d2 <= reach * reach).select("cx", "cy").distinct()


def band_statistics(raster: DataFrame, no_data: float) -> DataFrame:
    valid = raster.where((F.col("value") > no_data) & ~F.isnan("value"))
    return valid.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("n"))


def holes(mask: DataFrame, k: int, size: float, least_area: float) -> DataFrame:
    """Cells that closing with a k x k rectangle adds, in pieces of at least an area."""
    return without_small(closed(mask, k).join(mask.select("cx", "cy").distinct(), ["cx", "cy"], "left_anti"), size, least_area)


def largest(mask: DataFrame) -> DataFrame:
    """Cells of the component with the most cells, of equals the one with the least cell; at most one row of counts decides."""
    l = labelled(mask)
    first = l.groupBy("component").count().agg(F.max(F.struct("count", (-F.col("component")).alias("c"))).alias("m")).select((-F.col("m.c")).alias("component"))
    return l.join(first, "component", "left_semi").select("cx", "cy")


def scaled(mask: DataFrame, factor: float) -> DataFrame:
    """The mask in cells of another size: a cell is set where the middle of a new cell falls into a set one (growing), or a set one's middle falls into it (shrinking)."""
    if factor <= 1:
        at = lambda c: F.floor((F.col(c) + 0.5) * factor).alias(c)
        return mask.select(at("cx"), at("cy")).distinct()
    span = lambda c: F.explode(F.sequence(F.ceil(F.col(c) * factor - 0.5), F.ceil((F.col(c) + 1) * factor - 0.5) - 1))
    return mask.select("cx", "cy").distinct().withColumn("cx", span("cx")).withColumn("cy", span("cy"))


def hulls(cells: DataFrame, by: str) -> DataFrame:
    """by and ring (array of x, y, counter-clockwise from the least corner): the convex hull of each group's cell corners. Spark keeps the lowest and the highest cell of a column;
    only those, two a column, meet in a task."""
    import pandas as pd

    ends = cells.groupBy(by, "cx").agg(F.min("cy").alias("low"), (F.max("cy") + 1).alias("high"))
    corner = F.explode(F.array(*[F.struct((F.col("cx") + d).cast("double").alias("x"), F.col(c).cast("double").alias("y")) for d in (0, 1) for c in ("low", "high")])).alias("p")
    corners = ends.select(by, corner).select(by, "p.*").distinct()

    def hull(rows: pd.DataFrame) -> pd.DataFrame:
        at = sorted(zip(rows["x"], rows["y"]))

        def chain(points):
            out: list = []
            for p in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        return pd.DataFrame({by: [rows[by].iloc[0]], "ring": [[{"x": x, "y": y} for x, y in chain(at) + chain(at[::-1])]]})

    return corners.groupBy(by).applyInPandas(hull, f"{by} {dict(cells.dtypes)[by]}, ring array<struct<x:double,y:double>>")


#: Neighbours in a circle from the one above on, clockwise.
CIRCLE = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


def thinned(mask: DataFrame) -> DataFrame:
    """The mask's skeleton: in turns, cells on two opposite sides of the border go whose going parts nothing, until none goes. What goes depends on the eight
    neighbours: a look-up by their pattern. Each round is a sum over neighbours and a join, and is written."""
    spark, base = mask.sparkSession, scratch(mask.sparkSession, "thin")

    def goes(pattern: int, first: bool) -> bool:
        n = [pattern >> i & 1 for i in range(8)]
        turns = sum(not a and b for a, b in zip(n, n[1:] + n[:1]))
        up, right, down, left = n[0], n[2], n[4], n[6]
        one, two = (up * right * down, right * down * left) if first else (up * right * left, up * down * left)
        return 2 <= sum(n) <= 6 and turns == 1 and not one and not two

    now = written(mask.select("cx", "cy").distinct(), base, "cells-0")
    idle = i = 0
    while idle < 2:
        around = F.explode(F.array(*[F.struct((F.col("cx") - dx).alias("cx"), (F.col("cy") - dy).alias("cy"), F.lit(1 << k).alias("bit")) for k, (dx, dy) in enumerate(CIRCLE)])).alias("n")
        pattern = now.select(around).groupBy("n.cx", "n.cy").agg(F.sum("n.bit").alias("pattern"))
        table = F.array(*[F.lit(goes(p, i % 2 == 0)) for p in range(256)])
        gone = written(now.join(pattern, ["cx", "cy"]).where(F.element_at(table, F.col("pattern").cast("int") + 1)).select("cx", "cy"), base, f"gone-{i}")
        i += 1
        if gone.isEmpty():
            idle += 1
            continue
        idle = 0
        now = written(now.join(gone, ["cx", "cy"], "left_anti"), base, f"cells-{i}")
        removed(spark, base, f"gone-{i - 1}")
    return now


def tower_mask(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of candidate cells: the largest piece after closing, opening and closing, widened twice, and one row with its hull and middle."""
    piece = largest(closed(opened(closed(cells, 3), 2), 3))
    ring = hulls(piece.withColumn("piece", F.lit(0)), "piece").drop("piece")
    middle = piece.agg((F.avg("cx") + 0.5).alias("mx"), (F.avg("cy") + 0.5).alias("my"), (F.atan2(2 * F.covar_pop("cx", "cy"), F.covar_pop("cx", "cx") - F.covar_pop("cy", "cy")) / 2).alias("turn"))
    return dilated(dilated(piece, 3), 3), ring.crossJoin(middle)  # one row each


def class_mask(df: DataFrame, size: float, classes, without=(), reach: int = 3) -> DataFrame:
    """Closed cells of some classes, less the widened cells of others."""
    cells = lambda kinds: df.where(F.col("seg_type").isin(*kinds)).select(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).distinct()
    own = closed(cells(classes), reach)
    return own.join(dilated(cells(without), reach), ["cx", "cy"], "left_anti") if without else own
