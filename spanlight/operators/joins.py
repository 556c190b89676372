"""Spatial joins of point relations. Left and right sides are DataFrames with x, y, z; ids are named by their columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as g
from ..sources.staging import scratch, written

OFFSETS = (-1, 0, 1)


def remapped(df: DataFrame, mapping: dict[int, int], column: str = "seg_type") -> DataFrame:
    """Classes replaced through a map; classes that it lacks stay."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return df.withColumn(column, F.coalesce(table[F.col(column)], F.col(column)))


def imported_classes(df: DataFrame, tag: str, mapping: dict[int, int]) -> DataFrame:
    """Classes of imported points: of files whose ``software`` begins with a tag those of user_data, else those of the file through a map."""
    own = F.col("software").startswith(tag)
    return remapped(df, mapping).withColumn("seg_type", F.when(own, F.col("user_data")).otherwise(F.col("seg_type")))


def to_cell(df: DataFrame, size: float, origin: Sequence[float] = (0.0, 0.0), names=("cx", "cy")) -> DataFrame:
    for axis, start, name in zip("xyz", origin, names):
        df = df.withColumn(name, g.cell(F.col(axis), start, size))
    return df


def _buckets(df: DataFrame, radius: float, dims: str, around: bool) -> DataFrame:
    """Bucket coordinates of side radius; around: a row for each neighbouring bucket too."""
    for a in dims:
        df = df.withColumn(f"_b{a}", F.floor(F.col(a) / F.lit(float(radius))))
        if around:
            df = df.withColumn(f"_o{a}", F.explode(F.array(*map(F.lit, OFFSETS)))).withColumn(f"_b{a}", F.col(f"_b{a}") + F.col(f"_o{a}")).drop(f"_o{a}")
    return df


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, dims: str = "xyz") -> DataFrame:
    """left_id, right_id (renamed to a, b) and d2 of all pairs within the closed ball. Only the smaller side, the right, is
    copied to neighbouring buckets; both sides meet by an equi-join on buckets."""
    a = _buckets(left.select(F.col(left_id).alias("a"), *[F.col(c) for c in dims]), radius, dims, False)
    b = _buckets(right.select(F.col(right_id).alias("b"), *[F.col(c) for c in dims]), radius, dims, True)
    b = b.select("b", *[F.col(c).alias(f"_r{c}") for c in dims], *[f"_b{c}" for c in dims])
    d2 = sum(((F.col(c) - F.col(f"_r{c}")) * (F.col(c) - F.col(f"_r{c}")) for c in dims), F.lit(0.0))
    return a.join(b, [f"_b{c}" for c in dims]).select("a", "b", d2.alias("d2")).where(F.col("d2") <= radius * radius)


def crowded_radius(places: DataFrame, dims: str, start: float, most: float, each: float) -> float:
    """start, halved until a place's own bucket (edge: the radius) holds ``each`` places on average, seen from the places; at most 40 times."""
    fine = places.select(*[F.floor(F.col(c) / F.lit(start / 64)).alias(f"_b{c}") for c in dims]).groupBy(*[f"_b{c}" for c in dims]).agg(F.count(F.lit(1)).cast("double").alias("n"))
    coarse = [fine.groupBy(*[F.call_function("div", F.col(f"_b{c}") - F.pmod(F.col(f"_b{c}"), F.lit(1 << k)), F.lit(1 << k).cast("long")).alias(f"_b{c}") for c in dims]).agg(F.sum("n").alias("n")) for k in range(1, 7)]
    for k, cells in reversed(list(enumerate([fine, *coarse]))):
        if (cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0) <= each:
            return start / 64 * (1 << k)
    return crowded_radius(places, dims, start / 128, most, each) if start > most * 1e-9 else start / 64


def nearest(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, dims: str = "xyz", start: float = 1.0, skip_self: bool = False) -> DataFrame:
    """a, b, d2, rank: the k nearest right rows of each left row, ties by right id. Rows at one place are searched for once: a left place meets right places, of which
    each has its least ids only, one more than k. Places whose k-th neighbour lies within the radius of a round are done; the others go on with twice the radius, until everything is
    done or the radius covers the right side. The first radius is ``start`` or less, so that buckets hold few places however dense the cloud is. Each round is written."""
    spans = right.agg(*[(F.max(c) - F.min(c)).alias(c) for c in dims], *[F.min(c).alias(f"l{c}") for c in dims], F.count(F.lit(1)).alias("n")).first()
    reach = left.agg(*[F.max(F.abs(F.col(c) - F.lit(spans[f"l{c}"] or 0.0))).alias(c) for c in dims]).first()
    most = sum(((spans[c] or 0.0) + (reach[c] or 0.0)) for c in dims) + start
    base, i, need = scratch(left.sparkSession, "nearest"), 0, k + int(skip_self)
    at = [(F.col(c) + F.lit(0.0)).alias(c) for c in dims]  # -0.0 is 0.0
    valid = lambda df: df.where(F.expr(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in dims)))
    ids = valid(right).select(F.col(right_id).alias("b"), *at).withColumn("_i", F.row_number().over(Window.partitionBy(*dims).orderBy("b"))).where(F.col("_i") <= need)
    there = written(ids.groupBy(*dims).agg(F.sort_array(F.collect_list("b")).alias("_ids")), base, "right")
    rows = valid(left).select(F.col(left_id).alias("a"), *at)
    open_ = written(rows.select(*dims).distinct().withColumn("_p", F.monotonically_increasing_id()), base, "left")
    asked = open_
    radius, done = crowded_radius(there, dims, start, most, 2.0 * max(1.0, need / 4)), None
    by_p = Window.partitionBy("_p").orderBy("d2", "b")
    while True:
        n_open = open_.count()
        pairs = place_pairs(open_, there, radius, dims, n_open * 4 < (spans["n"] or 0))
        ranked = pairs.select("_p", "d2", F.explode("_ids").alias("b")).withColumn("rank", F.row_number().over(by_p)).where(F.col("rank") <= need)
        ranked = written(ranked, base, f"ranked-{i}")
        last = radius >= most
        full = ranked if last else ranked.join(ranked.where(F.col("rank") == need).select("_p"), "_p", "left_semi")
        done = full if done is None else done.unionByName(full)
        if last:
            break
        open_ = written(open_.join(ranked.where(F.col("rank") == need).select("_p"), "_p", "left_anti"), base, f"open-{i}")
        if open_.isEmpty():
            break
        radius, i = radius * 2, i + 1
    found = done.groupBy("_p").agg(F.sort_array(F.collect_list(F.struct("rank", "b", "d2"))).alias("_near")).join(asked, "_p").drop("_p")  # need of them at most
    near = rows.join(found, list(dims)).select("a", F.expr("filter(_near, n -> n.b <> a)" if skip_self else "_near").alias("_near"))
    return near.select("a", F.posexplode(F.slice("_near", 1, k)).alias("rank", "n")).select("a", "n.b", "n.d2", (F.col("rank") + 1).alias("rank"))


def place_pairs(left: DataFrame, right: DataFrame, radius: float, dims: str, few_left: bool) -> DataFrame:
    """_p, _ids and d2 of left places (_p) and right places (_ids) within the closed ball; the smaller side is the one copied to neighbouring buckets."""
    a = _buckets(left, radius, dims, few_left)
    b = _buckets(right.select("_ids", *[F.col(c).alias(f"_r{c}") for c in dims], *dims), radius, dims, not few_left).drop(*dims)
    d2 = sum(((F.col(c) - F.col(f"_r{c}")) * (F.col(c) - F.col(f"_r{c}")) for c in dims), F.lit(0.0))
    return a.join(b, [f"_b{c}" for c in dims]).select("_p", "_ids", d2.alias("d2")).where(F.col("d2") <= radius * radius)


def closest_pair(left: DataFrame, right: DataFrame, left_id: str, right_id: str, dims: str = "xyz", radius: float | None = None) -> DataFrame:
    """One row a, b, d: the closest pair, ties by ids; empty if a side is. The radius doubles until a pair is within it, at the latest when it spans both sides; it starts,
    unless given, at the edge that leaves about one right point a bucket, so dense clouds don't begin with all their pairs. The best pair of a round is written."""
    box = right.agg(F.count(F.lit(1)).alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in dims], *[f(c).alias(f"{k}{c}") for c in dims for k, f in (("l", F.min), ("h", F.max))]).first()
    other = left.agg(*[f(c).alias(f"{k}{c}") for c in dims for k, f in (("l", F.min), ("h", F.max))]).first()
    apart = None not in tuple(other) and None not in tuple(box)
    span = sum(max(box[f"h{c}"], other[f"h{c}"]) - min(box[f"l{c}"], other[f"l{c}"]) for c in dims) if apart else 0.0
    if radius is None:
        edges = [box[c] for c in dims if box[c]]
        volume = 1.0
        for e in edges:
            volume *= e
        radius = (volume / box["n"]) ** (1 / len(edges)) if edges else 1.0
    base, i = scratch(left.sparkSession, "closest"), 0
    while True:
        pairs = radius_pairs(left, right, radius, left_id, right_id, dims).orderBy("d2", "a", "b").limit(1).select("a", "b", F.sqrt("d2").alias("d"))
        best = written(pairs, base, str(i))
        if radius > span or not best.isEmpty():
            return best
        radius, i = radius * 2, i + 1


def nearest_ground(queries: DataFrame, ground: DataFrame, query_id: str, ground_id: str, radius: float) -> DataFrame:
    """Left outer: each query point with the XY-nearest ground point within a radius (ties by id), nulls without one."""
    pairs = radius_pairs(queries, ground, radius, query_id, ground_id, "xy")
    best = pairs.groupBy(F.col("a").alias(query_id)).agg(F.min(F.struct("d2", "b")).alias("m")).select(query_id, F.col("m.b").alias("ground_id"), F.sqrt("m.d2").alias("d_xy"))
    return queries.select(query_id).join(best, query_id, "left")


def min_vertical_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row d: by the z ranges of both sides: apart (either way), or the extreme of one against the closest of the other."""
    ra, rb = a.agg(F.min("z").alias("a1"), F.max("z").alias("a2")), b.agg(F.min("z").alias("b1"), F.max("z").alias("b2"))
    ranges = ra.crossJoin(rb)  # one row each
    near_b = b.select("z").crossJoin(F.broadcast(ra)).agg(F.min(F.abs(F.col("z") - F.col("a1"))).alias("db"))
    near_a = a.select("z").crossJoin(F.broadcast(rb)).agg(F.min(F.abs(F.col("z") - F.col("b1"))).alias("da"))
    d = F.when(F.col("a1") > F.col("b2"), F.col("a1") - F.col("b2")).when(F.col("a2") < F.col("b1"), F.col("b1") - F.col("a2")).when(F.col("a1").between(F.col("b1"), F.col("b2")), F.col("db")).otherwise(F.col("da"))
    return ranges.crossJoin(near_b).crossJoin(near_a).select(d.alias("d"))


def hag_from_raster(df: DataFrame, raster: DataFrame, size: float, origin: Sequence[float], reach: int = 2, top: Column | None = None) -> DataFrame:
    """Height above the ground raster (cx, cy, value): the cell's value, else the mean of valid cells up to ``reach`` away, else 0."""
    cells = to_cell(df, size, origin)
    need = cells.select("cx", "cy").distinct().join(raster, ["cx", "cy"], "left_anti")
    offsets = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    around = need.withColumn("ox", offsets).withColumn("oy", offsets).select("cx", "cy", (F.col("cx") + F.col("ox")).alias("nx"), (F.col("cy") + F.col("oy")).alias("ny"))
    near = raster.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), "value")
    filled = raster.select("cx", "cy", "value").unionByName(around.join(near, ["nx", "ny"]).groupBy("cx", "cy").agg(F.avg("value").alias("value")))
    filled = written(filled, scratch(df.sparkSession, "filled"), "raster")  # so Spark knows its size, and needn't shuffle the points if it is small
    hag = F.greatest(F.lit(0.0), F.col("z") - F.col("value"))
    out = cells.join(filled, ["cx", "cy"], "left").withColumn("hag", F.coalesce(hag if top is None else F.least(hag, top), F.lit(0.0)))
    return out.drop("cx", "cy", "value")


def segment_search(df: DataFrame, a: Sequence[float], b: Sequence[float], radius: float) -> DataFrame:
    """Points in the capsule around a segment; its box goes first, so the scan can skip."""
    box = F.lit(True)
    for axis, u, v in zip("xyz", a, b):
        box = box & F.col(axis).between(min(u, v) - radius, max(u, v) + radius)
    return df.where(box & (g.squared_segment_distance_3d([F.col(c) for c in "xyz"], a, b) <= radius * radius))
