"""Terrain as a triangulation (Delaunay) of ground points, and as a raster of heights on its triangles.

The plane is cut into tiles of a bounded number of points, and every tile is triangulated by itself. A triangle whose circle lies
within the tile is one of the whole triangulation, as no point elsewhere can lie in the circle. A point all of whose triangles
are such is finished. The others go to the next round with the finished points beside them, which keep what is known in place; being fewer,
they fill larger tiles, and tiles lie elsewhere. The last round is one tile that holds what is left: the points around the hull. So each
triangle comes out once, and none depends on the tiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import delaunay
from ..sources.staging import removed, scratch, written
from .joins import hag_from_raster

#: Points of a tile in the first round; each further round takes twice as many.
TILE_POINTS = 20_000
#: Points that a task triangulates together, of many tiles.
BATCH_POINTS = 40_000
_VERTEX = "struct<id: bigint, x: double, y: double, z: double>"
_TRIANGLE = f"a {_VERTEX}, b {_VERTEX}, c {_VERTEX}"


def tiles(df: DataFrame, most: int, low: tuple[float, float], side: float, base: str, name: str, n: int) -> DataFrame:
    """df (some n rows) with tile (level, and its place among the squares of side / 2^level): squares are quartered while they hold more than ``most`` points. Points are counted
    by the squares of some levels down, and these counts are summed upwards; only squares that are too dense there go further down."""
    top, open_, out = 0, df, None
    while True:
        fine = min(60, top + max(2, math.ceil(math.log(max(1.0, 8 * n / most), 4))))
        place = lambda c, k: F.floor((F.col(c) - low[k]) / F.lit(side / (1 << fine)))
        placed = open_.withColumn("_i", place("x", 0)).withColumn("_j", place("y", 1))
        counts = written(placed.groupBy("_i", "_j").agg(F.count(F.lit(1)).alias("_n")), base, f"{name}-counts-{top}")
        above = lambda c: F.expr(f"shiftright({c}, {fine} - _level)")
        squares = counts.withColumn("_level", F.explode(F.sequence(F.lit(top), F.lit(fine)))).withColumns({"_is": above("_i"), "_js": above("_j")})
        light = squares.groupBy("_level", "_is", "_js").agg(F.sum("_n").alias("_sum"))
        chosen = squares.join(light, ["_level", "_is", "_js"]).groupBy("_i", "_j").agg(F.first("_n").alias("_n"), F.min(F.when(F.col("_sum") <= most, F.col("_level"))).alias("_level"))
        if fine == 60:
            chosen = chosen.withColumn("_level", F.coalesce("_level", F.lit(60)))
        chosen = written(chosen, base, f"{name}-levels-{top}")
        level = F.col("_level")
        tile = F.struct(level.alias("level"), above("_i").alias("i"), above("_j").alias("j"))
        at = placed.join(chosen.drop("_n"), ["_i", "_j"])
        here = at.where(level.isNotNull()).select(*df.columns, tile.alias("tile"))
        out = here if out is None else out.unionByName(here)
        n = chosen.where(level.isNull()).agg(F.sum("_n")).first()[0]
        if n is None:
            return out
        open_ = written(at.where(level.isNull()).select(*df.columns), base, f"{name}-open-{top}")
        top = fine + 1


def _triangulated(tiled: DataFrame, low: tuple[float, float], side: float, whole: bool, box: Sequence[float]) -> DataFrame:
    """tiled points (id, x, y, z, known, tile) -> rows with a, b, c for the triangles found now, and ``open`` for those that touch unfinished points; and
    rows with ``finished``, the id of a finished point. Tiles are whole in a batch, many together."""

    def visit(table: pa.Table) -> pa.RecordBatch:
        level, i, j, ids, x, y, z, known = (table.column(k).to_numpy() for k in ("level", "i", "j", "id", "x", "y", "z", "known"))
        group = np.cumsum(np.r_[False, (level[1:] != level[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        size = side / np.exp2(level)
        x1, y1 = low[0] + i * size, low[1] + j * size
        # a little less than the tile, as bounds and circles are rounded; nothing lies beyond the bounds of all points
        x1, y1, x2, y2 = x1 + 1e-9 * size, y1 + 1e-9 * size, x1 + size * (1 - 1e-9), y1 + size * (1 - 1e-9)
        x1, y1 = np.where(x1 < box[0], -np.inf, x1), np.where(y1 < box[2], -np.inf, y1)
        x2, y2 = np.where(x2 > box[1], np.inf, x2), np.where(y2 > box[3], np.inf, y2)
        found = delaunay.many(group, x, y)
        real = found[:, 2] != delaunay.OUTSIDE
        a, b, c = found.T
        loose = np.zeros(len(ids), dtype=bool)
        if not whole:
            alone = np.ones(len(ids), dtype=bool)  # sets without triangles are not done
            alone[found[real].ravel()] = False
            loose |= alone & ~known
            edge = np.zeros(len(found), dtype=bool)  # on a side of all points' bounds
            for v, sides in ((x, box[:2]), (y, box[2:])):
                for s in sides:
                    edge |= (v[a] == s) & (v[b] == s)
            sure = np.where(real, proven(x, y, (a, b, np.where(real, c, a)), x1[a], y1[a], x2[a], y2[a]), edge)
            open_ = found[~sure]
            loose[open_[open_ != delaunay.OUTSIDE]] = True
        t = found[real]
        t = t[~known[t].any(axis=1) & ~loose[t].all(axis=1)]
        finished = np.flatnonzero(~loose & ~known)
        n, m = len(t), len(finished)
        none = pa.nulls(m, kind)
        corners = [pa.concat_arrays([pa.StructArray.from_arrays([pa.array(v[t[:, k]]) for v in (ids, x, y, z)], fields=list(kind)), none]) for k in range(3)]
        numbers = pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(ids[finished])])
        return pa.RecordBatch.from_arrays([*corners, pa.array(np.r_[loose[t].any(axis=1), np.zeros(m, dtype=bool)]), numbers], names=["a", "b", "c", "open", "finished"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH_POINTS:
                table = pa.Table.from_batches(held).combine_chunks()
                last = np.ones(rows, dtype=bool)
                for k in ("level", "i", "j"):
                    v = table.column(k).to_numpy()
                    last &= v == v[-1]
                cut = int(np.argmax(last))  # the last tile may go on
                if cut:
                    yield visit(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                rows -= cut
        if rows:
            yield visit(pa.Table.from_batches(held))

    kind = pa.struct([("id", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
    rows = tiled.select("tile.*", "id", "x", "y", "z", "known")
    rows = (rows.coalesce(1) if whole else rows.repartition("level", "i", "j")).sortWithinPartitions("level", "i", "j")
    return rows.mapInArrow(run, f"{_TRIANGLE}, open boolean, finished bigint")


def proven(x, y, t, x1, y1, x2, y2):
    """Whether triangles' circles lie in boxes; no, where rounding could matter."""
    a, b, c = t
    bx, by, cx, cy = x[b] - x[a], y[b] - y[a], x[c] - x[a], y[c] - y[a]
    b2, c2, det = bx * bx + by * by, cx * cx + cy * cy, 2 * (bx * cy - by * cx)
    flat = np.abs(det) <= 1e-6 * np.maximum(b2, c2)
    det = np.where(flat, 1.0, det)
    ox, oy = (cy * b2 - by * c2) / det, (bx * c2 - cx * b2) / det
    r = np.sqrt(ox * ox + oy * oy) * (1 + 1e-6)
    return ~flat & (x1 <= x[a] + ox - r) & (x[a] + ox + r <= x2) & (y1 <= y[a] + oy - r) & (y[a] + oy + r <= y2)


def triangulation(df: DataFrame, tile_points: int = TILE_POINTS) -> DataFrame:
    """df with x, y, z -> a, b, c (structs with x, y, z) of the Delaunay triangles of its places, each turning left. The lowest of several
    points at a place counts; rows with a null or not finite number don't. Of cocircular points the one first by x, then y, decides. Points on
    one line, or fewer than three places, have no triangles."""
    spark = df.sparkSession
    base = scratch(spark, "terrain")
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in "xyz"]
    places = df.where(finite[0] & finite[1] & finite[2]).groupBy(*[(F.col(c).cast("double") + 0.0).alias(c) for c in "xy"]).agg(F.min(F.col("z").cast("double")).alias("z"))
    points = written(places.withColumn("id", F.monotonically_increasing_id()).withColumn("known", F.lit(False)), base, "points-0")
    box = points.agg(*[f(c) for c in "xy" for f in (F.min, F.max)]).first()
    if box[0] is None:
        return spark.createDataFrame([], _TRIANGLE)
    extent = max(box[1] - box[0], box[3] - box[2], 1e-9) * 1.000001
    done, frontier, n = [], None, 0
    while True:
        shift = n * 0.6180339887 % 1  # tiles of another round lie elsewhere
        low, side = (box[0] - shift * extent, box[2] - shift * extent), 2 * extent
        most = tile_points * 2**n
        held = points.count()
        whole = held <= most
        tiled = points.withColumn("tile", F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))) if whole else tiles(points, most, low, side, base, f"tiles-{n}", held)
        found = written(_triangulated(tiled, low, side, whole, tuple(box)), base, f"found-{n}")
        done.append(found.where("finished is null").select("a", "b", "c"))
        if whole:
            break
        left = points.where("not known").join(found.where("finished is not null").select(F.col("finished").alias("id")), "id", "left_anti")
        edge = found.where("finished is null and open").select("a", "b", "c")
        edge = edge if frontier is None else edge.unionByName(frontier)
        corners = edge.select("a", "b", "c", F.explode(F.array("a", "b", "c")).alias("v"))
        frontier = written(corners.join(left.select(F.col("id").alias("_id")), F.col("v.id") == F.col("_id"), "left_semi").select("a", "b", "c").distinct(), base, f"frontier-{n}")
        beside = frontier.select(F.explode(F.array("a", "b", "c")).alias("v")).select("v.*").distinct().join(left.select("id"), "id", "left_anti").withColumn("known", F.lit(True))
        points = written(left.unionByName(beside), base, f"points-{n + 1}")
        removed(spark, base, f"points-{n}", *([f"frontier-{n - 1}"] if n else []))
        n += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def rasterised(triangles: DataFrame, cell: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """cx, cy, value: the height of the triangle over each cell's middle; of several that meet there, the least. Each triangle is dealt to the rows that it
    crosses, and there to the cells between its sides, so nothing is made beyond the result."""
    middle = lambda c, k: (c + 0.5) * cell + origin[k]
    ys = [F.col(f"{k}.y") for k in "abc"]
    first = lambda v, k: F.ceil((v - origin[k]) / cell - 0.5)
    last = lambda v, k: F.floor((v - origin[k]) / cell - 0.5)
    low, high = first(F.least(*ys), 1), last(F.greatest(*ys), 1)
    rows = triangles.where(low <= high).select("a", "b", "c", F.explode(F.sequence(low, high)).alias("cy"))
    y = middle(F.col("cy"), 1)

    def crossing(p: str, q: str) -> Column:
        """Where the side from p to q meets the row, null if it doesn't."""
        py, qy = F.col(f"{p}.y"), F.col(f"{q}.y")
        at = F.col(f"{p}.x") + (F.col(f"{q}.x") - F.col(f"{p}.x")) * ((y - py) / (qy - py))
        return F.when(py == qy, F.when(py == y, F.col(f"{p}.x"))).when((F.least(py, qy) <= y) & (y <= F.greatest(py, qy)), at)

    sides = [crossing(*s) for s in ("ab", "bc", "ca")] + [F.when(F.col(f"{k}.y") == y, F.col(f"{k}.x")) for k in "abc"]
    slack = cell * 1e-9
    rows = rows.withColumns({"_l": first(F.least(*sides) - slack, 0), "_r": last(F.greatest(*sides) + slack, 0)}).where("_l <= _r")
    cells = rows.select("a", "b", "c", "cy", F.explode(F.sequence("_l", "_r")).alias("cx"))
    x = middle(F.col("cx"), 0)
    area = lambda p, q: (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0])
    a, b, c = [(F.col(f"{k}.x"), F.col(f"{k}.y")) for k in "abc"]
    total = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    value = (area(b, c) * F.col("a.z") + area(c, a) * F.col("b.z") + area(a, b) * F.col("c.z")) / total
    return cells.select("cx", "cy", value.alias("value")).groupBy("cx", "cy").agg(F.min("value").alias("value"))


def terrain(ground: DataFrame, cell: float, origin: tuple[float, float] = (0.0, 0.0), tile_points: int = TILE_POINTS) -> DataFrame:
    """cx, cy, value: the raster of the triangulation of ground points."""
    return rasterised(triangulation(ground, tile_points), cell, origin)


def normalised(df: DataFrame, ground_class: int = 1, voxel: float = 0.5, cell: float = 1.0, tile_points: int = TILE_POINTS) -> DataFrame:
    """df with hag: ground points are thinned to voxel centroids, triangulated, and heights are those above the raster of triangles; beyond the
    triangles near cells stand in, and where there are none the height is 0."""
    from .aggregates import voxel_centroids

    thin = voxel_centroids(df.where(F.col("seg_type") == ground_class), voxel)
    raster = written(terrain(thin, cell, (0.0, 0.0), tile_points), scratch(df.sparkSession, "heights"), "raster")
    return hag_from_raster(df, raster, cell, (0.0, 0.0))


