"""Classification of point clouds, composed of rasters, stencils, clusters and joins: ground, height above ground, vegetation, towers, roads, trees."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import aggregates as a, graph, windows as w
from ..sources.staging import scratch, written
from .joins import hag_from_raster, to_cell


def window_schedule(cell: float, slope: float, first: float, most: float, max_window: float, base: int = 2, exponential: bool = True) -> list[tuple[int, float]]:
    """(half size, height threshold) of each round; the last window may exceed the maximum."""
    out, before, i = [], 0.0, 0
    while before < max_window:
        half = base**i if exponential else (i + 1) * base
        width = 2 * half + 1
        out.append((half, first if not i else min(slope * (width - before) * cell + first, most)))
        before, i = width, i + 1
    return out


def ground_limits(df: DataFrame, cell: float = 5.0, slope: float = 1.0, first: float = 0.5, most: float = 3.0, max_window: float = 9) -> DataFrame:
    """df with _top, the height below which a point is ground by progressive morphological filtering: the surface of least heights is opened with growing windows, and points less than
    the window's threshold above the opened surface stay. Each round is one pair of windows over the (small) raster. The raster of limits is written, so Spark knows that it is small and
    needn't shuffle the points to meet it."""
    placed = df.withColumn("_cx", F.floor(F.col("x") / F.lit(float(cell)))).withColumn("_cy", F.floor(F.col("y") / F.lit(float(cell))))
    surface = placed.groupBy(F.col("_cx").alias("cx"), F.col("_cy").alias("cy")).agg(F.min("z").alias("value"))
    limit = None
    for half, threshold in window_schedule(cell, slope, first, most, max_window):
        surface = w.stencil(w.stencil(surface, half, "min"), half, "max")
        here = surface.select("cx", "cy", (F.col("value") + threshold).alias("top"))
        limit = here if limit is None else limit.unionByName(here)
    # a point stays if it is below the least of its cell's limits
    least = written(limit.groupBy(F.col("cx").alias("_cx"), F.col("cy").alias("_cy")).agg(F.min("top").alias("_top")), scratch(df.sparkSession, "limits"), "least")
    return placed.join(least, ["_cx", "_cy"], "left").drop("_cx", "_cy")


def ground(df: DataFrame, cell: float = 5.0, slope: float = 1.0, first: float = 0.5, most: float = 3.0, max_window: float = 9) -> DataFrame:
    """Ground points, those below ``ground_limits``."""
    return ground_limits(df, cell, slope, first, most, max_window).where("z < _top").drop("_top")


def normalised(df: DataFrame, ground_class: int = 1, voxel: float = 0.5, cell: float = 5.0) -> DataFrame:
    """df with hag: ground points are thinned to voxel centroids, averaged per raster cell, and looked up with a fallback to near cells."""
    thin = a.voxel_centroids(df.where(F.col("seg_type") == ground_class), voxel)
    raster = to_cell(thin, cell).groupBy("cx", "cy").agg(F.avg("z").alias("value"))
    return hag_from_raster(df, raster, cell, (0.0, 0.0))


def vegetation(df: DataFrame, low: float, high: float) -> DataFrame:
    """Unclassified and vegetation points by height: 3 low, 4 medium, 15 high."""
    return df.withColumn("seg_type", F.when(F.col("seg_type").isin(2, 15, 255), F.when(F.col("hag") < low, 3).when(F.col("hag") < high, 4).otherwise(15)).otherwise(F.col("seg_type")))


def tower_cells(df: DataFrame, cell: float, least_height: float, z_step: float, count_sd: float, least_fill: float) -> DataFrame:
    """Cells that look like towers: high, filled from top to bottom, and with unusually many high points."""
    p = df.withColumn("cx", F.floor(F.col("x") / F.lit(float(cell)))).withColumn("cy", F.floor(F.col("y") / F.lit(float(cell))))
    cells = p.groupBy("cx", "cy").agg(F.max("hag").alias("h"), F.count_if(F.col("hag") > least_height).alias("fn")).where(F.col("h") >= least_height)
    runs = w.vertical_runs(p.withColumn("z", F.col("hag")), z_step, "cx", "cy").groupBy("cx", "cy").agg(F.sum("length").alias("runs"))
    cells = cells.join(runs, ["cx", "cy"]).withColumn("fv", F.col("runs") / F.col("h"))
    stats = cells.where("fn > 0").agg(F.avg("fn").alias("_m"), F.stddev_samp("fn").alias("_s"))
    return cells.crossJoin(F.broadcast(stats)).where((F.col("fn") - F.col("_m") > count_sd * F.col("_s")) & (F.col("fv") > least_fill)).select("cx", "cy", "h", "fn", "fv")


def road_regions(df: DataFrame, cell: float, flat: float, step: float, area: Sequence[float]) -> DataFrame:
    """Cells of roads: ground cells of little relief, grown over small steps, of an area in [low, high)."""
    cells = df.groupBy(F.floor(F.col("x") / F.lit(float(cell))).alias("cx"), F.floor(F.col("y") / F.lit(float(cell))).alias("cy")).agg((F.max("z") - F.min("z")).alias("dz"), F.max("z").alias("top")).where(F.col("dz") <= flat)
    grown = graph.grown_regions(cells, "top", step)
    kept = grown.groupBy("component").agg((F.count(F.lit(1)) * cell * cell).alias("area")).where((F.col("area") >= area[0]) & (F.col("area") < area[1]))
    return grown.join(kept.select("component"), "component", "left_semi").select("cx", "cy", "component")


def crowns(tops: DataFrame, th_tree: float, th_seed: float, th_crown: float, most: int, top_factor: float = 1.05) -> DataFrame:
    """tops (cx, cy, z, seed: id or 0) -> cx, cy, tree: seeds grow over 4-neighbours in sweeps over the whole raster until nothing changes. A sweep
    goes by cx, then cy: cells are free if they were before it, a tree's mean moves with each cell it takes, and of several trees the last keeps the cell. Each
    sweep joins the trees' edges to free cells; a tree's steps are folded in order, no more than four for each cell within its reach."""
    base = scratch(tops.sparkSession, "crowns")
    cells = written(tops.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("z").cast("double").alias("h"), "seed"), base, "cells")
    seeds = cells.where("seed <> 0").select(F.col("seed").cast("long").alias("tree"), F.col("nx").alias("cx"), F.col("ny").alias("cy"), "h")
    labelled = seeds.select("cx", "cy", "tree")
    trees = seeds.select("tree", F.col("cx").alias("sx"), F.col("cy").alias("sy"), F.col("h").alias("top"), F.col("h").alias("total"), F.lit(1).cast("long").alias("n"))
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("cx") + dx).alias("nx"), (F.col("cy") + dy).alias("ny")) for k, (dx, dy) in enumerate(((0, -1), (-1, 0), (1, 0), (0, 1)))]))
    for i in itertools.count():  # each sweep labels a cell at least, or is the last
        edges = labelled.select("tree", "cx", "cy", sides.alias("side")).select("tree", "cx", "cy", "side.*").join(trees, "tree")
        edges = edges.where(F.greatest(F.abs(F.col("nx") - F.col("sx")), F.abs(F.col("ny") - F.col("sy"))) < most)
        edges = edges.join(cells, ["nx", "ny"]).where((F.col("h") > th_tree) & (F.col("h") > F.col("top") * F.lit(th_seed)) & (F.col("h") <= F.col("top") * F.lit(top_factor)))
        edges = edges.join(labelled.select(F.col("cx").alias("nx"), F.col("cy").alias("ny")), ["nx", "ny"], "left_anti")
        steps = edges.groupBy("tree", "total", "n").agg(F.sort_array(F.collect_list(F.struct("cx", "cy", "k", "nx", "ny", "h"))).alias("steps"))
        taken = f"cast(array() as {dict(steps.dtypes)['steps']})"
        grow = f"""aggregate(steps, named_struct('total', total, 'n', n, 'taken', {taken}), (s, e) -> if(e.h > s.total / s.n * {th_crown!r}D,
            named_struct('total', s.total + e.h, 'n', s.n + 1L, 'taken', concat(s.taken, array(e))), s))"""
        grown = written(steps.select("tree", F.expr(grow).alias("s")).select("tree", "s.*").where("size(taken) > 0"), base, f"grown{i}")
        if grown.isEmpty():
            break
        new = grown.select("tree", F.explode("taken").alias("e")).groupBy(F.col("e.nx").alias("cx"), F.col("e.ny").alias("cy")).agg(F.max_by("tree", F.struct("e.cx", "e.cy", "e.k")).alias("tree"))
        labelled = written(labelled.unionByName(new), base, f"labelled{i}")
        moved = grown.select("tree", F.col("total").alias("_total"), F.col("n").alias("_n"))
        trees = trees.join(moved, "tree", "left").withColumns({"total": F.coalesce("_total", "total"), "n": F.coalesce("_n", "n")}).drop("_total", "_n")
        trees = written(trees, base, f"trees{i}")
    return labelled


def blocks(df: DataFrame, size: float, overlap: float) -> DataFrame:
    """Points with the overlapping square blocks (bx, by) that they fall in."""
    stride = size - overlap
    first = lambda c: F.floor((F.col(c) - size) / stride) + 1
    last = lambda c: F.floor(F.col(c) / stride)
    return df.withColumn("bx", F.explode(F.sequence(first("x"), last("x")))).withColumn("by_", F.explode(F.sequence(first("y"), last("y"))))


def unit_sphere(df: DataFrame, *by: str) -> DataFrame:
    """Coordinates of each group less their mean, over the largest distance from it."""
    mean = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m{c}") for c in "xyz"])
    moved = df.join(mean, list(by)).withColumns({c: F.col(c) - F.col(f"_m{c}") for c in "xyz"}).drop("_mx", "_my", "_mz")
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    reach = moved.groupBy(*by).agg(F.max(r).alias("_r"))
    return moved.join(reach, list(by)).withColumns({c: F.coalesce(F.col(c) / F.nullif(F.col("_r"), F.lit(0.0)), F.lit(0.0)) for c in "xyz"}).drop("_r")


def sampled_curve(fits: DataFrame, step: float) -> DataFrame:
    """fits (a, b, c, y_min, y_max) -> also y and z of places along the curve."""
    n = F.floor((F.col("y_max") - F.col("y_min")) / step).cast("int")
    placed = fits.withColumn("_i", F.explode(F.sequence(F.lit(0), n))).withColumn("y", F.col("y_min") + F.col("_i") * F.lit(float(step))).drop("_i")
    return placed.withColumn("z", F.col("a") * F.col("y") * F.col("y") + F.col("b") * F.col("y") + F.col("c"))


def softmax(scores: Column) -> Column:
    """Array of scores -> array of shares, stable against large scores."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


def argmax(scores: Column) -> Column:
    """Place of the first largest score, from 0."""
    return F.array_position(scores, F.array_max(scores)) - 1
