"""Clustering by closeness: connected components of voxels and of points, denoising, region growing.

Components are found in rounds (``stars``) that are written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import removed, scratch, written
from .aggregates import voxel
from .joins import nearest, radius_pairs


def stars(edges: DataFrame, write: Callable[[DataFrame, str], DataFrame], drop: Callable[[str], None]) -> DataFrame:
    """edges (u, v), one direction or both -> (u, v) with v the least id that u reaches, for all u but those least ids.

    In a round every id ties itself and its neighbours to the least of them; a round in which all were tied to it alone is the last, after a number of
    rounds that grows with the logarithm of the longest path. Ids with very many neighbours (the least one of a large component is sure to be one) make no hot
    task: least neighbours are partial minima, they come back to the edges by a join whose hot keys Spark splits, and edges are told apart by both
    ends. write and drop keep a round's edges in the shared folder."""
    u, v = F.least("u", "v"), F.greatest("u", "v")
    state, i = write(edges.where("u <> v").select(v.alias("u"), u.alias("v")).distinct().withColumn("moved", F.lit(True)), "0"), 0
    while not state.where("moved").isEmpty():
        both = state.select(F.col("u").alias("id"), F.col("v").alias("near")).unionByName(state.select(F.col("v").alias("id"), F.col("u").alias("near")))
        least = both.groupBy("id").agg(F.min("near").alias("m")).select("id", F.least("id", "m").alias("m"))
        rows = both.join(least.hint("merge"), "id").select("id", "near", "m", ((F.col("id") != F.col("m")) & (F.col("near") != F.col("m"))).alias("moved"))
        ties = F.explode(F.array(F.struct(F.col("id").alias("u"), F.col("m").alias("v")), F.struct(F.col("near").alias("u"), F.col("m").alias("v")))).alias("t")
        tied = rows.select("moved", ties).select("t.*", "moved").where("u <> v")
        state = write(tied.groupBy("u", "v").agg(F.max("moved").alias("moved")), str(i + 1))
        drop(str(i))
        i += 1
    return state.select("u", "v")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id), edges (u, v), one direction or both -> id, component: the least id of its component."""
    spark = nodes.sparkSession
    base = scratch(spark, "components")
    found = stars(edges, lambda df, name: written(df, base, name), lambda name: removed(spark, base, name))
    return nodes.join(found.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


class Grid:
    """Numbers the cells of a table, whose indices lie in columns: ids rise with the indices from left to right, and a neighbour's id is
    the cell's plus a constant. The table's bounds set the numbers, so it may lie anywhere; too many cells for 63 bits are an error."""

    def __init__(self, names: Sequence[str], low: Sequence[int], high: Sequence[int]):
        self.names, self.low = tuple(names), [v - 1 for v in low]  # a margin on each side keeps neighbours apart
        self.counts = [b - a + 3 for a, b in zip(low, high)]
        if math.prod(self.counts) >= 1 << 63:
            raise ValueError(f"{' x '.join(map(str, self.counts))} cells have no numbers of 63 bits; take larger cells")

    @classmethod
    def of(cls, cells: DataFrame, names: Sequence[str]) -> Grid:
        row = cells.agg(*[F.min(n) for n in names], *[F.max(n) for n in names]).first()
        return cls(names, [int(v or 0) for v in row[: len(names)]], [int(v or 0) for v in row[len(names) :]])

    @classmethod
    def of_points(cls, df: DataFrame, size: float, dims: str = "xyz") -> Grid:
        return cls.of(df.select(*[F.floor(F.col(c) / F.lit(float(size))).alias(c) for c in dims]), list(dims))

    def id(self, *columns: Column) -> Column:
        """The number of a cell, of the columns of its names unless others are given."""
        out = F.lit(0).cast("long")
        for c, low, n in zip(columns or map(F.col, self.names), self.low, self.counts):
            out = out * n + (c.cast("long") - low)
        return out

    def steps(self) -> list[int]:
        """From a cell's number to those of its neighbours, diagonal ones and itself too."""
        out = [0]
        for n in self.counts:
            out = [s * n + d for s in out for d in (-1, 0, 1)]
        return out

    def cell(self, number: Column, *names: str) -> list[Column]:
        """The indices of a numbered cell."""
        out, below = [], 1
        for name, low, n in reversed(list(zip(names or self.names, self.low, self.counts))):
            whole = F.call_function("div", number, F.lit(below).cast("long"))
            out.append((whole % n + low).alias(name))
            below *= n
        return out[::-1]


def cell_edges(cells: DataFrame, grid: Grid, keep: Column | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (u, v) of neighbouring cells (with ``id``), diagonal ones too; keep: a condition on the carried columns and those with prefix n_. Only
    the half of the neighbours with larger numbers is asked for."""
    around = cells.select(F.col("id").alias("u"), F.explode(F.array(*[F.col("id") + F.lit(s) for s in grid.steps() if s > 0])).alias("v"), *carried)
    other = cells.select(F.col("id").alias("v"), *[F.col(c).alias(f"n_{c}") for c in carried])
    pairs = around.join(other, "v")
    return (pairs if keep is None else pairs.where(keep)).select("u", "v")


def _least(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n numbers the least that it reaches over the pairs (u, v)."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        far = a != b
        if not far.any():
            return label
        u, v, a, b = u[far], v[far], a[far], b[far]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label[label], label):
            label = label[label]


def labelled_cells(cells: DataFrame, grid: Grid, n: str | None = None) -> DataFrame:
    """cells (id; n, a number of each) -> id, component (its least cell), size (the sum of n, or its cells): neighbouring cells, diagonal ones too, are connected.

    The grid is cut into blocks of at most some 36,000 cells, each with the next layer of cells of the blocks that follow, so every pair of neighbours lies in one. Blocks are
    labelled by themselves, many in a batch; only labels that share a cell of such a layer go into rounds, so a dense grid has few."""
    spark, base, d = cells.sparkSession, scratch(cells.sparkSession, "cells"), len(grid.counts)
    side = int(32768 ** (1 / d) + 1e-9)
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    at, below = [], 1
    for count in reversed(grid.counts):
        at.insert(0, div(F.col("id"), below) % count)
        below *= count
    counts = [c // side + 2 for c in grid.counts]

    def spread(blocks: Column, i: Column, count: int) -> Column:
        """Numbers of blocks with one more index: that of the cell's own block, and of the one before if the cell is in its own's first layer."""
        own = div(i, side) + 1
        each = lambda b: F.when(i % side == 0, F.array(b * count + own, b * count + own - 1)).otherwise(F.array(b * count + own))
        return F.flatten(F.transform(blocks, each))

    blocks = F.array(F.lit(0).cast("long"))
    for i, count in zip(at, counts):
        blocks = spread(blocks, i, count)
    rows = cells.select("id", (F.lit(1) if n is None else F.col(n)).cast("long").alias("n"), blocks.alias("_b"))
    rows = rows.select("id", "n", F.element_at("_b", 1).alias("_own"), (F.size("_b") > 1).alias("shared"), F.explode("_b").alias("block")).select("block", "id", "n", "shared", (F.col("_own") == F.col("block")).alias("own"))
    sizes, widths = list(grid.counts), [side + 3] * d

    def label(table: pa.Table) -> pa.RecordBatch:
        block, ids = table.column("block").to_numpy(), table.column("id").to_numpy()
        code, places, blocks, left = np.cumsum(np.r_[0, block[1:] != block[:-1]]), [], block.copy(), ids.copy()
        for k in reversed(range(d)):
            places.insert(0, left % sizes[k] - (blocks % counts[k] - 1) * side + 1)
            left, blocks = left // sizes[k], blocks // counts[k]
        steps = [0]
        for place, width in zip(places, widths):
            code = code * width + place
            steps = [s * width + o for s in steps for o in (-1, 0, 1)]
        u, v = [], []  # codes rise with the rows, as blocks and ids do
        for s in steps:
            if s > 0:
                to = np.minimum(np.searchsorted(code, code + s), len(code) - 1)
                near = np.flatnonzero(code[to] == code + s)
                u.append(near)
                v.append(to[near])
        found = ids[_least(len(ids), np.concatenate(u), np.concatenate(v))]
        return pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), pa.array(found), *[table.column(c).combine_chunks() for c in ("n", "shared", "own")]], names=["id", "label", "n", "shared", "own"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= side**d:
                table = pa.Table.from_batches(held).combine_chunks()
                block = table.column("block").to_numpy()
                whole = int(np.searchsorted(block, block[-1]))  # the last block may go on
                if whole:
                    yield label(table.slice(0, whole).combine_chunks())
                held = table.slice(whole).combine_chunks().to_batches()
                rows -= whole
        if rows:
            yield label(pa.Table.from_batches(held).combine_chunks())

    local = written(rows.repartition("block").sortWithinPartitions("block", "id").mapInArrow(run, "id long, label long, n long, shared boolean, own boolean"), base, "local")
    met = local.where("own AND shared").select("id", F.col("label").alias("u")).join(local.where("NOT own").select("id", F.col("label").alias("v")), "id")
    found = stars(met.select("u", "v"), lambda df, name: written(df, base, name), lambda name: removed(spark, base, name)).select(F.col("u").alias("label"), F.col("v").alias("_least"))
    labels = local.groupBy("label").agg(F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("n")).join(found, "label", "left").select("label", "n", F.coalesce("_least", "label").alias("component"))
    labels = written(labels, base, "labels")
    of = labels.join(labels.groupBy("component").agg(F.sum("n").alias("size")), "component").select("label", "component", "size")
    return local.where("own").select("id", "label").join(of, "label").select("id", "component", "size")


def _voxel_components(df: DataFrame, size: float, dims: str, grid: Grid | None) -> DataFrame:
    """df with component and _size, the number of its points."""
    grid = grid or Grid.of_points(df, size, dims)
    placed = df.withColumn("_cell", grid.id(*[F.floor(F.col(c) / F.lit(float(size))) for c in dims]))
    cells = placed.where(F.col("_cell").isNotNull()).groupBy(F.col("_cell").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    found = labelled_cells(cells, grid, "n").select(F.col("id").alias("_cell"), "component", F.col("size").alias("_size"))
    return placed.drop("component").join(found, "_cell").drop("_cell")


def voxel_components(df: DataFrame, size: float, dims: str = "xyz", grid: Grid | None = None) -> DataFrame:
    """df with component: occupied voxels of an edge are connected over faces, edges and corners. A component's number is that of its least
    voxel in the grid (``Grid.of_points``, unless one is given)."""
    return _voxel_components(df, size, dims, grid).drop("_size")


def voxel_clusters(df: DataFrame, size: float, low: int, high: int, high_included: bool, dims: str = "xyz", grid: Grid | None = None) -> DataFrame:
    """``voxel_components`` of between low and high points."""
    n = F.col("_size")
    return _voxel_components(df, size, dims, grid).where((n >= low) & ((n <= high) if high_included else (n < high))).drop("_size")


def sized(df: DataFrame, low: int, high: int, high_included: bool) -> DataFrame:
    """Points whose component has between low and high points."""
    n = F.count(F.lit(1)).alias("_size")
    kept = df.groupBy("component").agg(n).where((F.col("_size") >= low) & ((F.col("_size") <= high) if high_included else (F.col("_size") < high)))
    return df.join(kept.select("component"), "component", "left_semi")


def euclidean_components(df: DataFrame, key: str, tolerance: float, dims: str = "xyz") -> DataFrame:
    """df with component: points connect within the tolerance (closed). A point without a place is alone.

    Points of a cell whose diagonal is below the tolerance are connected. Cells are linked where their outermost points are near enough; only cells that are not connected
    by then, and whose boxes are, meet point by point, with those points that the other's box is near to. So dense clouds don't make all their pairs."""
    spark, base, names = df.sparkSession, scratch(df.sparkSession, "near"), [f"_c{c}" for c in dims]
    if not tolerance > 0:
        pairs = radius_pairs(df, df, tolerance or 1.0, key, key, dims).where(F.col("d2") <= tolerance * tolerance).where("a < b").select(F.col("a").alias("u"), F.col("b").alias("v"))
        return df.join(components(df.select(F.col(key).alias("id")), pairs).withColumnRenamed("id", key), key)
    size, limit = tolerance / math.sqrt(len(dims)) * (1 - 1e-6), tolerance * tolerance
    finite = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in dims)
    at = df.where(finite).select(F.col(key).alias("id"), *[F.floor(F.col(c) / F.lit(size)).alias(n) for c, n in zip(dims, names)], F.struct(*[F.col(c).cast("double").alias(c) for c in dims]).alias("p"))
    ends = F.array_distinct(F.array(*[f("p", f"p.{c}") for c in dims for f in (F.min_by, F.max_by)])).alias("ends")
    cells = written(at.groupBy(*names).agg(F.min("id").alias("id"), ends, *[f(f"p.{c}").alias(f"{k}{c}") for c in dims for k, f in (("l", F.min), ("h", F.max))]), base, "cells")
    half = [o for o in itertools.product(range(-2, 3), repeat=len(dims)) if o > (0,) * len(dims)]
    around = cells.withColumn("_o", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, names)]) for o in half])))
    around = around.select(*[(F.col(n) + F.col(f"_o.{n}")).alias(n) for n in names], *[F.col(n).alias(f"u{n}") for n in names], *[F.col(c).alias(f"u_{c}") for c in ("id", "ends", *[k + c for c in dims for k in "lh"])])
    gap = lambda low, high, l2, h2: F.greatest(F.lit(0.0), l2 - high, low - h2)
    apart = sum((g * g for g in (gap(F.col(f"u_l{c}"), F.col(f"u_h{c}"), F.col(f"l{c}"), F.col(f"h{c}")) for c in dims)), F.lit(0.0))
    d2 = lambda p, q: sum(((p[c] - q[c]) * (p[c] - q[c]) for c in dims), F.lit(0.0))
    linked = F.exists("u_ends", lambda p: F.exists("ends", lambda q: d2(p, q) <= limit))
    pairs = written(around.join(cells, names).where(apart <= limit * (1 + 1e-9)).withColumn("linked", linked).drop("u_ends", "ends"), base, "pairs")
    spread = lambda edges, name: stars(edges, lambda d, n: written(d, base, f"{name}-{n}"), lambda n: removed(spark, base, f"{name}-{n}"))
    first = written(cells.select("id").join(spread(pairs.where("linked").select(F.col("u_id").alias("u"), F.col("id").alias("v")), "first").withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("root")), base, "roots")
    open_ = pairs.where("NOT linked").join(first.select(F.col("id").alias("u_id"), F.col("root").alias("u")), "u_id").join(first.select("id", F.col("root").alias("v")), "id").where("u <> v").drop("linked")
    places = at.select(*names, "p").distinct()
    reach = lambda p, k: sum((g * g for g in (F.greatest(F.lit(0.0), F.col(f"{k}l{c}") - p[c], p[c] - F.col(f"{k}h{c}")) for c in dims)), F.lit(0.0)) <= limit * (1 + 1e-9)
    met = open_.join(places.select(*[F.col(n).alias(f"u{n}") for n in names], F.col("p").alias("_p")), [f"u{n}" for n in names]).where(reach(F.col("_p"), "")).select(*names, "u", "v", "_p", *[f"u_{k}{c}" for c in dims for k in "lh"])
    met = met.join(places, names).where(reach(F.col("p"), "u_") & (d2(F.col("_p"), F.col("p")) <= limit)).select("u", "v").distinct()
    second = spread(met, "second").select(F.col("u").alias("root"), F.col("v").alias("_least"))
    of = first.join(second, "root", "left").select("id", F.coalesce("_least", "root").alias("component"))
    found = at.select(F.col("id").alias(key), *names).join(cells.select(*names, "id").join(of, "id").select(*names, "component"), names).select(key, "component")
    return df.drop("component").join(found, key, "left").withColumn("component", F.coalesce("component", key))


def denoise_by_size(df: DataFrame, size: float, min_points: int, grid: Grid | None = None) -> DataFrame:
    """df with component and outlier: its voxel component has under min_points points."""
    return _voxel_components(df, size, "xyz", grid).withColumn("outlier", F.col("_size") < min_points).drop("_size")


def denoise_statistical(df: DataFrame, key: str, k: int, factor: float, start: float) -> DataFrame:
    """key, d (mean distance of the k nearest), outlier: d above the mean plus factor standard deviations of all."""
    d = nearest(df, df, k, key, key, start=start, skip_self=True).groupBy(F.col("a").alias(key)).agg(F.avg(F.sqrt("d2")).alias("d"))
    stats = d.agg(F.avg("d").alias("_m"), F.stddev_samp("d").alias("_s"))
    return d.crossJoin(F.broadcast(stats)).select(key, "d", (F.col("d") > F.col("_m") + factor * F.col("_s")).alias("outlier"))


def denoise_radius(df: DataFrame, radius: float, min_points: int) -> DataFrame:
    """Points in voxels of side 2 radius with more than min_points."""
    dense = df.groupBy(*voxel(2 * radius)).count().where(F.col("count") > min_points).drop("count")
    return df.withColumns({f"v{c}": F.floor(F.col(c) / F.lit(2.0 * radius)) for c in "xyz"}).join(dense, ["vx", "vy", "vz"], "left_semi").drop("vx", "vy", "vz")


def grown_regions(cells: DataFrame, value: str, step: float, grid: Grid | None = None) -> DataFrame:
    """cells (cx, cy, value) with component: neighbouring cells connect if their values differ by less than step."""
    grid = grid or Grid.of(cells, ("cx", "cy"))
    placed = cells.withColumn("id", grid.id())
    close = F.abs(F.col(value) - F.col(f"n_{value}")) < step
    return placed.join(components(placed.select("id"), cell_edges(placed, grid, close, (value,))), "id").drop("id")


def merged_positions(df: DataFrame, key: str, distance: float, dims: str = "xy") -> DataFrame:
    """component (its least key), the mean position and n: positions within a distance of each other, over any number of steps, are one."""
    found = euclidean_components(df, key, distance, dims)
    return found.groupBy("component").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n"))


def grown_from(cells: DataFrame, seed: Column, allowed: Column, carried: tuple[str, ...] = (), names: tuple[str, ...] = ("cx", "cy")) -> DataFrame:
    """cells that are seeds or reached from one over neighbours (diagonal ones too), each step allowed by a condition on the carried columns
    of a cell and, with prefix n_, of the next one. Each round joins the newest cells to their neighbours and is written; it ends when none is new."""
    spark, i = cells.sparkSession, 0
    base = scratch(spark, "grown")
    grid = Grid.of(cells, names)
    placed, steps = written(cells.withColumn("id", grid.id()).withColumn("_seed", F.coalesce(seed, F.lit(False))), base, "cells"), grid.steps()
    new = found = written(placed.where("_seed").select("id"), base, "found-0")
    other = placed.select(F.col("id").alias("_next"), *[F.col(c).alias(f"n_{c}") for c in carried])
    while not new.isEmpty():
        i += 1
        around = placed.join(new, "id").withColumn("_next", F.explode(F.array(*[F.col("id") + F.lit(s) for s in steps if s])))
        reached = around.join(other, "_next").where(allowed).select(F.col("_next").alias("id")).distinct()
        new = written(reached.join(found, "id", "left_anti"), base, f"new-{i}")
        found = written(found.unionByName(new), base, f"found-{i}")
        removed(spark, base, f"found-{i - 1}")
    return placed.join(found, "id", "left_semi").drop("id", "_seed")
