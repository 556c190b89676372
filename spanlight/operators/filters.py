"""Filters, predicates and relabelling of point relations (columns x, y, z, seg_type and what the function names)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as g


def field_range(df: DataFrame, field: str, low: float, high: float) -> DataFrame:
    """Rows with the field between low and high, both included."""
    return df.where(F.col(field).between(low, high))


def of_class(df: DataFrame, label: int, box: Sequence[float] | None = None) -> DataFrame:
    """Points of a class, in a half-open box if given."""
    out = df.where(F.col("seg_type") == label)
    return out if box is None else out.where(g.in_half_open_box(F.col("x"), F.col("y"), box))


def relabel(df: DataFrame, label: int, where: Column | None = None) -> DataFrame:
    return df.withColumn("seg_type", F.lit(label) if where is None else F.when(where, label).otherwise(F.col("seg_type")))


def subset(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    """The points that a selection names."""
    return df.join(ids, list(on), "left_semi")


def spatial(kind: str, shape) -> Column:
    """Predicate of a query shape: polygon (ring), box_xy (4 numbers), box (6 numbers), circle (x, y, radius) or sphere (x, y, z, radius)."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    if kind == "polygon":
        xs, ys = [p[0] for p in shape], [p[1] for p in shape]
        return g.in_box(x, y, (min(xs), min(ys), max(xs), max(ys))) & g.in_polygon(x, y, shape)
    if kind == "box_xy":
        return g.in_box(x, y, shape)
    if kind == "box":
        return x.between(shape[0], shape[3]) & y.between(shape[1], shape[4]) & z.between(shape[2], shape[5])
    if kind == "circle":
        cx, cy, r = shape
        return x.between(cx - r, cx + r) & ((x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r)
    if kind == "sphere":
        cx, cy, cz, r = shape
        return x.between(cx - r, cx + r) & ((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) <= r * r)
    raise ValueError(f"unknown kind of shape: {kind}")


def visible(df: DataFrame, hide: Sequence[int] | None = ()) -> DataFrame:
    """Shown points whose class isn't hidden; none without a list."""
    if hide is None:
        return df.where(F.lit(False))
    return df.where(F.col("display_enable") & ~F.col("seg_type").isin(*hide)) if hide else df.where("display_enable")


def head(df: DataFrame, height: float, z_low: Column, z_high: Column) -> DataFrame:
    """Points above the larger of the robust bottom and the robust top less ``height``."""
    return df.where(F.col("z") > F.greatest(z_low, z_high - height))


def candidates(df: DataFrame, kind: str) -> DataFrame:
    """Default selections: above_ground, unclassified, near_ground or loose_vegetation."""
    return df.where({
        "above_ground": "seg_type <> 1 AND hag > 0", "unclassified": "seg_type = 255",
        "near_ground": "seg_type = 1 OR hag < 3", "loose_vegetation": "seg_type IN (2, 15) AND tree_id = 0",
    }[kind])


def write_back(df: DataFrame, shape, remap: dict[int, int], outlier: Column, enabled: Sequence[int], keep_noise=(4, 5)) -> DataFrame:
    """New class and visibility of points with ``new_type``: only visible points inside the polygon and of an enabled class change;
    outliers, unless of a kept class, are hidden; classes are remapped, 15 collapses to 2."""
    inside = spatial("polygon", shape) & F.col("display_enable")
    target = F.col("new_type")
    if remap:
        target = F.coalesce(F.create_map(*[F.lit(v) for kv in remap.items() for v in kv])[target], target)
    target = F.when(target == 15, 2).otherwise(target)
    noise = inside & outlier & ~F.col("new_type").isin(*keep_noise)
    return df.withColumn("seg_type", F.when(inside & ~noise & target.isin(*enabled), target).otherwise(F.col("seg_type"))).withColumn("display_enable", F.col("display_enable") & ~noise)


def tiles(df: DataFrame, size: float) -> DataFrame:
    """Tiles of an edge with their boxes and numbers of points."""
    tx, ty = F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty")
    return df.groupBy(tx, ty).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def _corners_in(ring: g.Ring) -> list[Column]:
    return [g.in_polygon(F.col(x), F.col(y), ring) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]


def _touched(ring: g.Ring) -> Column:
    """Whether a vertex of the polygon lies in a tile's box or one of its sides crosses one of the box's; the sides are one literal array."""
    x1, y1, x2, y2 = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    sides = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for v, k in zip(e, ("ax", "ay", "bx", "by"))]) for e in g.edges(ring)])
    box = F.array(*[F.struct(*[v.alias(k) for v, k in zip(e, ("cx", "cy", "dx", "dy"))]) for e in ((x1, y1, x2, y1), (x2, y1, x2, y2), (x2, y2, x1, y2), (x1, y2, x1, y1))])
    vertex = F.exists(sides, lambda e: e["ax"].between(x1, x2) & e["ay"].between(y1, y2))
    return vertex | F.exists(sides, lambda e: F.exists(box, lambda o: g.segments_cross(e["ax"], e["ay"], e["bx"], e["by"], o["cx"], o["cy"], o["dx"], o["dy"])))


def tile_may_meet(ring: g.Ring) -> Column:
    """Whether a tile's box can hold points of a polygon: the boxes overlap and a corner is inside, a vertex is inside the box, or a side crosses one of the box's sides."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    found = _touched(ring)
    for corner in _corners_in(ring):
        found = found | corner
    return (F.col("xmin") <= max(xs)) & (F.col("xmax") >= min(xs)) & (F.col("ymin") <= max(ys)) & (F.col("ymax") >= min(ys)) & found


#: Tiles of about 24 bytes each that are broadcast at most.
BROADCAST_TILES = 1 << 16


def ring_tiles(spark, ring: g.Ring, size: float) -> DataFrame:
    """tx, ty, inside of the tiles of a size that may hold points of a polygon, by the tiles' own edges: as many rows as its box has tiles, and
    marked for broadcast if these are up to BROADCAST_TILES."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    few = ((max(xs) - min(xs)) / size + 2) * ((max(ys) - min(ys)) / size + 2) <= BROADCAST_TILES
    span = lambda v: F.sequence(F.floor(F.lit(float(min(v))) / size), F.floor(F.lit(float(max(v))) / size))
    cells = spark.range(1).select(F.explode(span(xs)).alias("tx")).withColumn("ty", F.explode(span(ys)))
    boxes = cells.select("tx", "ty", (F.col("tx") * size).alias("xmin"), (F.col("ty") * size).alias("ymin"), ((F.col("tx") + 1) * size).alias("xmax"), ((F.col("ty") + 1) * size).alias("ymax"))
    # a side along a tile's edge crosses nothing, so boxes are looked at a little wider
    wider = boxes.withColumns({c: F.col(c) + d * 1e-6 * size for c, d in (("xmin", -1), ("ymin", -1), ("xmax", 1), ("ymax", 1))})
    found = tiles_by_cover(wider, ring)
    return F.broadcast(found) if few else found


def tiles_by_cover(tile_table: DataFrame, ring: g.Ring) -> DataFrame:
    """Tiles that may meet the polygon, with ``inside``: all four corners lie in it and none of its vertices or sides in the tile."""
    corners = F.lit(True)
    for corner in _corners_in(ring):
        corners = corners & corner
    return tile_table.where(tile_may_meet(ring)).withColumn("inside", corners & ~_touched(ring))
