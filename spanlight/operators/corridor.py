"""Power corridors and buildings: towers are located and ordered, wires are found in the spans between them and fitted, roofs are planes; and the
whole segmentation with its options, as one plan of joins and aggregates.

Points have a key, x, y, z, seg_type and hag (height above ground). Classes are those of ``sources.points``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import aggregates as a, classify, filters, fits, graph, raster
from ..sources.files import Options
from ..sources.points import BUILDING, GROUND, TOWER, WIRE
from ..sources.staging import removed, scratch, written
from .windows import numbered


def tower_positions(df: DataFrame, cell: float, least_height: float, z_step: float = 4.0, count_sd: float = 1.0, least_fill: float = 0.5, apart: float | None = None) -> DataFrame:
    """tower (from 1 on along the line), x, y, height: cells that look like towers, joined to pieces, their middles, those closer than ``apart`` (twice the cell) as one, in order along
    the main direction of all."""
    cells = classify.tower_cells(df, cell, least_height, z_step, count_sd, least_fill)
    pieces = raster.labelled(cells).join(cells.select("cx", "cy", "h"), ["cx", "cy"])
    middles = pieces.groupBy(F.col("component").alias("id")).agg(((F.avg("cx") + 0.5) * cell).alias("x"), ((F.avg("cy") + 0.5) * cell).alias("y"), F.max("h").alias("z"))
    found = written(graph.merged_positions(middles, "id", apart or 2 * cell), scratch(df.sparkSession, "towers"), "found")
    axis = a.plane_axis(found)
    place = (F.col("x") - F.col("mx")) * F.col("ux") + (F.col("y") - F.col("my")) * F.col("uy")
    along = found.crossJoin(F.broadcast(axis)).withColumn("along", place)  # the axis is one row
    return numbered(along, [F.col("along"), F.col("component")], "tower").select("tower", "x", "y", F.col("z").alias("height"))


def spans(towers: DataFrame) -> DataFrame:
    """span, x1, y1, x2, y2 between consecutive towers."""
    after = towers.select((F.col("tower") - 1).alias("tower"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return towers.select("tower", F.col("x").alias("x1"), F.col("y").alias("y1")).join(after, "tower").select(F.col("tower").alias("span"), "x1", "y1", "x2", "y2")


def tower_points(df: DataFrame, towers: DataFrame, radius: float, least_hag: float = 1.0) -> DataFrame:
    """df with tower (null away from all): the nearest tower within a radius of points off the ground. Both sides meet on cells of that size."""
    place = lambda d, c: F.floor(F.col(c) / radius)
    near = towers.select("tower", F.col("x").alias("tx"), F.col("y").alias("ty"), F.explode(F.sequence(place(towers, "x") - 1, place(towers, "x") + 1)).alias("_cx"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_oy"))
    near = near.withColumn("_cy", F.floor(F.col("ty") / radius) + F.col("_oy")).groupBy("_cx", "_cy").agg(F.collect_list(F.struct("tower", "tx", "ty")).alias("_near"))  # towers of a cell are few
    d2 = lambda t: (F.col("x") - t.tx) * (F.col("x") - t.tx) + (F.col("y") - t.ty) * (F.col("y") - t.ty)
    best = F.array_min(F.transform(F.filter("_near", lambda t: d2(t) <= radius * radius), lambda t: F.struct(d2(t).alias("d2"), t.tower.alias("tower"))))
    placed = df.withColumn("_cx", place(df, "x")).withColumn("_cy", place(df, "y")).join(near, ["_cx", "_cy"], "left")
    return placed.select(*df.columns, F.when(F.col("hag") >= least_hag, best).alias("_t")).select(*df.columns, F.col("_t.tower").alias("tower"))


def wire_candidates(df: DataFrame, span_table: DataFrame, reach: float, least_hag: float) -> DataFrame:
    """df with span, for points high above ground within ``reach`` of a span's line; spans meet points on the cells that their boxes cover."""
    from ..functions.geometry import squared_segment_distance

    size = 4 * reach
    grid = lambda u, v: F.explode(F.sequence(F.floor((F.least(u, v) - reach) / size), F.floor((F.greatest(u, v) + reach) / size)))
    cells = span_table.withColumn("_cx", grid(F.col("x1"), F.col("x2"))).withColumn("_cy", grid(F.col("y1"), F.col("y2")))
    placed = df.where(F.col("hag") >= least_hag).withColumn("_cx", F.floor(F.col("x") / size)).withColumn("_cy", F.floor(F.col("y") / size))
    d2 = squared_segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return placed.join(cells, ["_cx", "_cy"]).where(d2 <= reach * reach).select(*df.columns, "span")


def wires(df: DataFrame, span_table: DataFrame, key: str, reach: float = 20.0, least_hag: float = 5.0, voxel: float = 2.0, least: int = 10, linearity: float = 0.9, within: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Wires and their points: candidates of a span are clustered by voxels, clusters that are small, steep or not linear go, the others are fitted (``wire_fit``) and
    take all candidates of their span within a distance. Returns fits (span, component, ...) and key, span, component of the points (the nearest wire of each)."""
    base = scratch(df.sparkSession, "wires")
    near = written(wire_candidates(df.select(key, "x", "y", "z", "hag"), span_table, reach, least_hag), base, "candidates")
    clusters = written(graph.voxel_components(near, voxel), base, "clusters")
    spread = written(a.eigenvalues(a.covariance(clusters, "span", "component")), base, "spread")
    shape = a.shape_features(spread)
    # the share of height in the spread: a steep cluster's main direction is up
    kept = shape.where((F.col("n") >= least) & (F.col("linearity") >= linearity) & (F.col("czz") < 0.5 * (F.col("cxx") + F.col("cyy") + F.col("czz"))))
    fitted = written(fits.wire_fit(clusters.join(kept.select("span", "component"), ["span", "component"], "left_semi"), "span", "component").where("a is not null"), base, "fits")
    t, across, above = fits.wire_distance(F.col("x"), F.col("y"), F.col("z"))
    d2 = across * across + above * above
    taken = near.join(fitted, "span").where((t >= F.col("t1") - within) & (t <= F.col("t2") + within) & (d2 <= within * within))
    best = taken.groupBy(key).agg(F.min(F.struct(d2.alias("d2"), "span", "component")).alias("w"))
    return fitted, best.select(key, "w.span", "w.component")


def local_linearity(df: DataFrame, size: float) -> DataFrame:
    """vx, vy, vz, n and linearity of the points of each voxel and those around it: moments are summed a voxel, and then over neighbours. Moments are about the
    voxel's own corner, so they keep their digits far from the origin."""
    names = ("vx", "vy", "vz")
    placed = df.select(*[F.floor(F.col(c) / size).alias(n) for c, n in zip("xyz", names)], *[(F.col(c) - F.floor(F.col(c) / size) * size).alias(c) for c in "xyz"])
    pairs = [(p, q) for i, p in enumerate("xyz") for q in "xyz"[i:]]
    sums = placed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{c}") for c in "xyz"], *[F.sum(F.col(p) * F.col(q)).alias(f"s{p}{q}") for p, q in pairs])
    step = F.array(*map(F.lit, (-1, 0, 1)))
    around = sums
    for n in names:
        around = around.withColumn(f"_o{n}", F.explode(step)).withColumn(n, F.col(n) + F.col(f"_o{n}"))
    # moments moved to the corner of the voxel they count for, where this one lies at minus its offset
    d = {c: -F.col(f"_ov{c}") * size for c in "xyz"}
    moved = around.select(*names, "n", *[(F.col(f"s{c}") + F.col("n") * d[c]).alias(f"s{c}") for c in "xyz"], *[(F.col(f"s{p}{q}") + d[p] * F.col(f"s{q}") + d[q] * F.col(f"s{p}") + F.col("n") * d[p] * d[q]).alias(f"s{p}{q}") for p, q in pairs])
    total = moved.groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sz", *[f"s{p}{q}" for p, q in pairs])]).join(sums.select(*names), list(names), "left_semi")
    spread = total.select(*names, "n", *[(F.col(f"s{p}{q}") / F.col("n") - F.col(f"s{p}") * F.col(f"s{q}") / F.col("n") / F.col("n")).alias(f"c{p}{q}") for p, q in pairs])
    return a.shape_features(a.eigenvalues(spread)).select(*names, "n", "linearity")


def linear_points(df: DataFrame, size: float, least: float) -> DataFrame:
    """Points in voxels of a local linearity of at least ``least``."""
    names = ["vx", "vy", "vz"]
    kept = written(local_linearity(df, size), scratch(df.sparkSession, "linear"), "voxels").where(F.col("linearity") >= least).select(*[F.col(n).alias(f"_{n}") for n in names])
    placed = df.withColumns({f"_{n}": F.floor(F.col(c) / size) for c, n in zip("xyz", names)})
    return placed.join(kept, [f"_{n}" for n in names], "left_semi").drop(*[f"_{n}" for n in names])


def tower_parts(df: DataFrame, towers: DataFrame, key: str, radius: float, cell: float, head: float, least: int = 10) -> DataFrame:
    """key, tower, part (head or body) of tower points: those near a tower within the hull of its cells with points from ground to head; the head is what lies up
    to ``head`` below the top, and voxel pieces of under ``least`` points are noise."""
    near = written(tower_points(df.select(key, "x", "y", "z", "hag"), towers, radius).where("tower is not null"), scratch(df.sparkSession, "parts"), "near")
    top = near.groupBy("tower").agg(F.max("z").alias("_top"), F.max("hag").alias("_high"))
    cells = near.join(top, "tower").groupBy("tower", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.min("hag").alias("low"), F.max("hag").alias("up"), F.first("_high").alias("h"))
    core = cells.where((F.col("up") >= F.col("h") / 2) | (F.col("low") < F.col("h") / 2) & (F.col("up") >= F.col("h") / 4)).select("tower", "cx", "cy")
    ring = raster.hulls(core, "tower")
    side = lambda p, q: (q["x"] - p["x"]) * (F.col("y") / cell - p["y"]) - (q["y"] - p["y"]) * (F.col("x") / cell - p["x"]) >= 0
    inside = F.forall(F.sequence(F.lit(1), F.size("ring")), lambda i: side(F.element_at("ring", i), F.element_at("ring", i % F.size("ring") + 1)))
    held = near.join(ring, "tower").where(inside).join(top, "tower").drop("ring", "_high")
    kept = graph.voxel_clusters(held, 2 * cell, least, 1 << 60, True)
    return kept.select(key, "tower", F.when(F.col("z") > F.col("_top") - head, "head").otherwise("body").alias("part"))


def corridor(df: DataFrame, key: str, cell: float, least_height: float, towers: DataFrame | None = None, radius: float = 10.0, **wire_options) -> DataFrame:
    """df with new seg_type: towers (located, or given) and wires. Nothing changes unless there are two towers at least."""
    found = written(towers if towers is not None else tower_positions(df, cell, least_height), scratch(df.sparkSession, "corridor"), "towers")
    if found.limit(2).count() < 2:
        return df
    _, on_wire = wires(df, spans(found), key, **wire_options)
    with_tower = tower_points(df.where(F.col("seg_type") != GROUND), found, radius).where("tower is not null").select(key, F.lit(True).alias("_tower"))
    out = df.join(with_tower, key, "left").join(on_wire.select(key, F.lit(True).alias("_wire")), key, "left")
    return out.withColumn("seg_type", F.when(F.col("_wire"), WIRE).when(F.col("_tower"), TOWER).otherwise(F.col("seg_type"))).drop("_tower", "_wire")


def hang_points(fitted: DataFrame, span_table: DataFrame) -> DataFrame:
    """span, component, side (1 or 2), x, y, z: where wires, prolonged, reach the towers at their ends."""
    ends = fitted.join(span_table, "span")
    place = lambda i: (F.col(f"x{i}") - F.col("mx")) * F.col("ux") + (F.col(f"y{i}") - F.col("my")) * F.col("uy")
    at = ends.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), place(i).alias("t")) for i in (1, 2)])).alias("e")).select("*", "e.*")
    t = F.col("t")
    return at.select("span", "component", "side", (F.col("mx") + t * F.col("ux")).alias("x"), (F.col("my") + t * F.col("uy")).alias("y"), (F.col("a") * t * t + F.col("b") * t + F.col("c")).alias("z"))


def buildings(df: DataFrame, key: str, cell: float = 1.0, least_hag: float = 2.0, voxel: float = 1.0, least: int = 30, within: float = 0.15, share: float = 0.6) -> DataFrame:
    """key of building points: high points, clustered by voxels; clusters of enough points most of which lie on one plane are roofs, and what lies within
    twice the distance of that plane belongs to them."""
    base = scratch(df.sparkSession, "buildings")
    high = df.where((F.col("hag") >= least_hag) & ~F.col("seg_type").isin(GROUND, WIRE, TOWER))
    clusters = graph.voxel_components(high.select(key, "x", "y", "z"), voxel)
    clusters = written(graph.sized(clusters, least, 1 << 60, True), base, "clusters")
    plane = fits.best_planes(clusters, "component", [key], within)
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    roofs = written(plane.join(sizes, "component").where(F.col("inliers") >= share * F.col("n")), base, "roofs")
    off = F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") - F.col("d"))
    return clusters.join(roofs, "component").where(off <= 2 * within).select(key)


def steep_regions(surface: DataFrame, size: float, degrees: float = 35.0, least_area: float = 0.0) -> DataFrame:
    """Cells of steep slopes, opened and closed, in pieces of an area at least."""
    from . import windows as w

    steep = w.slope(surface, size).where(F.col("slope") > degrees).select("cx", "cy")
    return raster.without_small(raster.closed(raster.opened(steep, 3), 3), size, least_area)


#: What a kind of segmentation does with (points, key, options).
SEGMENTATIONS: dict[str, Callable[[DataFrame, str, Options], DataFrame]] = {}


def segmentation(kind: str):
    def add(f):
        SEGMENTATIONS[kind] = f
        return f

    return add


@segmentation("ground")
def _ground(df: DataFrame, key: str, o: Options) -> DataFrame:
    found = classify.ground_limits(df, o.cell, o.ground_slope)
    return found.withColumn("seg_type", F.when(F.col("z") < F.col("_top"), GROUND).when(F.col("seg_type") == GROUND, 255).otherwise(F.col("seg_type"))).drop("_top")


@segmentation("vegetation")
def _vegetation(df: DataFrame, key: str, o: Options) -> DataFrame:
    return classify.vegetation(classify.normalised(df.drop("hag")), o.low_height, o.high_height)


@segmentation("buildings")
def _buildings(df: DataFrame, key: str, o: Options) -> DataFrame:
    found = buildings(classify.normalised(df.drop("hag")), key).select(key, F.lit(True).alias("_b"))
    return df.join(found, key, "left").withColumn("seg_type", F.when(F.col("_b"), BUILDING).otherwise(F.col("seg_type"))).drop("_b")


def create(kind: str) -> Callable[[DataFrame, str, Options], DataFrame]:
    if kind not in SEGMENTATIONS:
        raise ValueError(f"unknown kind of segmentation: {kind}")
    return SEGMENTATIONS[kind]


def segmented(df: DataFrame, key: str, options: Options, shape: Sequence[Sequence[float]] | None = None, enabled: Sequence[int] | None = None, progress: Callable[[str, int, int], None] | None = None) -> DataFrame:
    """df after the options' kinds one after the other, each written, with the first class beside the new one; with a polygon and enabled classes, results are written back only to
    visible points inside it."""
    base, kinds, out = scratch(df.sparkSession, "segmented"), [k.strip() for k in options.kinds.split(",") if k.strip()], df.withColumn("_first_type", F.col("seg_type"))
    for i, kind in enumerate(kinds):
        out = written(create(kind)(out, key, options).select(*df.columns, "_first_type"), base, f"{i}-{kind}")
        if i:
            removed(df.sparkSession, base, f"{i - 1}-{kinds[i - 1]}")
        if progress:
            progress(kind, i + 1, len(kinds))
    if shape is None:
        return out.drop("_first_type")
    new = out.withColumn("new_type", F.col("seg_type")).withColumn("seg_type", F.col("_first_type")).drop("_first_type")
    return filters.write_back(new, shape, {}, F.lit(False), enabled or [], () if not options.keep_noise else (4, 5)).select(*df.columns)


def visited(df: DataFrame, holds: Callable[[dict[str, Column]], Column], totals: dict[str, Callable[[dict[str, Column]], Column]], first: Sequence[str] = ()) -> DataFrame:
    """One row of totals over the points for which a callback holds; with ``first`` (an order) of the first such point only, so the visit may end there. Callbacks get columns by name."""
    columns = {c: F.col(c) for c in df.columns}
    hit = df.where(holds(columns))
    if first:
        hit = hit.orderBy(*first).limit(1)
    return hit.agg(*[f(columns).alias(name) for name, f in totals.items()])


def remapped_by(df: DataFrame, function: Callable[[int], int], classes: Sequence[int]) -> DataFrame:
    """Classes replaced by what a function gives for each of ``classes``; it is called once a class, on the driver."""
    out = F.col("seg_type")
    for c in classes:
        out = F.when(F.col("seg_type") == c, F.lit(function(c))).otherwise(out)
    return df.withColumn("seg_type", out)


def visited_cells(df: DataFrame, size: float, visit: Callable, schema: str) -> DataFrame:
    """A callback over the points of each cell (a data frame with cx, cy); a cell is a piece of bounded size."""
    placed = df.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    return placed.groupBy("cx", "cy").applyInPandas(visit, schema)
