"""Stencils, gaps and islands and ordered computations over cells, layers and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def vertical_runs(df: DataFrame, step: float, *cell: str) -> DataFrame:
    """Runs of occupied height bins in each cell: first and last bin and length."""
    bins = df.select(*cell, F.floor(F.col("z") / F.lit(float(step))).alias("bin")).distinct()
    island = F.col("bin") - F.row_number().over(Window.partitionBy(*cell).orderBy("bin"))
    return bins.withColumn("island", island).groupBy(*cell, "island").agg(F.min("bin").alias("first"), F.max("bin").alias("last")).withColumn("length", (F.col("last") - F.col("first") + 1) * F.lit(float(step))).drop("island")


def stencil(raster: DataFrame, half: int, how: str) -> DataFrame:
    """raster (cx, cy, value) with the min or max over (2 half + 1)² cells, clipped at the border: along rows, then along columns."""
    f = {"min": F.min, "max": F.max}[how]
    for along, across in (("cx", "cy"), ("cy", "cx")):
        w = Window.partitionBy(across).orderBy(along).rangeBetween(-half, half)
        raster = raster.withColumn("value", f("value").over(w))
    return raster


def neighbours(cells: DataFrame, reach: int, columns: Sequence[str], bounds: Sequence[int] | None = None, centre: bool = False) -> DataFrame:
    """cx, cy and the columns (with prefix n_) of each cell's neighbours; with bounds (x0, y0, x1, y1) places beyond repeat the border cells."""
    offset = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    around = cells.select("cx", "cy").withColumn("ox", offset).withColumn("oy", offset)
    if not centre:
        around = around.where("ox <> 0 OR oy <> 0")
    nx, ny = F.col("cx") + F.col("ox"), F.col("cy") + F.col("oy")
    if bounds:
        nx, ny = F.greatest(F.lit(bounds[0]), F.least(nx, F.lit(bounds[2]))), F.greatest(F.lit(bounds[1]), F.least(ny, F.lit(bounds[3])))
    around = around.select("cx", "cy", "ox", "oy", nx.alias("nx"), ny.alias("ny"))
    other = cells.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), *[F.col(c).alias(f"n_{c}") for c in columns])
    return around.join(other, ["nx", "ny"])


def kernel(raster: DataFrame, weights: Sequence[Sequence[float]]) -> DataFrame:
    """Weighted sum over the cells around each cell; absent cells add nothing."""
    reach = len(weights) // 2
    table = F.array(*[F.array(*map(F.lit, map(float, row))) for row in weights])
    n = neighbours(raster, reach, ["value"], centre=True)
    w = F.element_at(F.element_at(table, F.col("oy") + reach + 1), F.col("ox") + reach + 1)
    return n.groupBy("cx", "cy").agg(F.sum(w * F.col("n_value")).alias("value"))


def slope(raster: DataFrame, size: float) -> DataFrame:
    """Degrees, by central differences over two cells; an absent neighbour counts as 0."""
    def step(along: str, across: str) -> Column:
        w = Window.partitionBy(across).orderBy(along)
        before = F.when(F.lag(along).over(w) == F.col(along) - 1, F.lag("value").over(w))
        after = F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead("value").over(w))
        return (F.coalesce(after, F.lit(0.0)) - F.coalesce(before, F.lit(0.0))) / F.lit(2.0 * size)

    out = raster.withColumn("gx", step("cx", "cy")).withColumn("gy", step("cy", "cx"))
    return out.select("cx", "cy", F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))).alias("slope"))


def local_maxima(tops: DataFrame, radius: Column, most: float, key: str) -> DataFrame:
    """Rows that no row within their own radius exceeds in z (ties: the one with the lesser key stays)."""
    from .joins import radius_pairs

    t = tops.withColumn("_radius", radius)
    pairs = radius_pairs(t, t, most, key, key, "xy")
    a, b = t.select(F.col(key).alias("a"), F.col("z").alias("za"), "_radius"), t.select(F.col(key).alias("b"), F.col("z").alias("zb"))
    beaten = pairs.where("a <> b").join(a, "a").join(b, "b").where((F.col("d2") <= F.col("_radius") * F.col("_radius")) & ((F.col("zb") > F.col("za")) | ((F.col("zb") == F.col("za")) & (F.col("b") < F.col("a")))))
    return tops.join(beaten.select(F.col("a").alias(key)).distinct(), key, "left_anti")


def detail_level(place: Column) -> Column:
    """Level of detail of a point by its place: one in 100 is on level 3, of the rest one in 25 on 2, one in 5 on 1."""
    return F.when(place % 100 == 0, 3).when(place % 25 == 0, 2).when(place % 5 == 0, 1).otherwise(0)


def densest_slices(slices: DataFrame, ahead: int) -> DataFrame:
    """slices (slice, n): the fullest slice in each forward window of ``ahead`` slices that are there, as a set. Each slice goes to the windows that it is in by its place,
    so no task holds the whole order."""
    placed = numbered(slices, [F.col("slice")], "_place")
    each = placed.select(F.explode(F.sequence(F.col("_place") - (ahead - 1), F.col("_place"))).alias("first"), F.struct("n", (-F.col("slice")).alias("s")).alias("v"))
    return each.where("first > 0").groupBy("first").agg(F.max("v").alias("v")).select((-F.col("v.s")).alias("slice")).distinct()


def packed_boxes(tiles: DataFrame, order: str, count: str, parts: int) -> DataFrame:
    """Tiles packed along an order into boxes of about total / parts points: by the running sum, which is added up within ranges and moved on by the
    sums of the ranges before (one row a range)."""
    from ..sources.staging import scratch, written

    rows = written(tiles.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), scratch(tiles.sparkSession, "packed"), "rows")
    sums = rows.groupBy("_part").agg(F.sum(count).alias("_sum"))
    whole = Window.orderBy("_part")
    before = sums.select("_part", (F.sum("_sum").over(whole) - F.col("_sum")).alias("_before"), F.sum("_sum").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    running = F.sum(count).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("_running", F.coalesce(running, F.lit(0))).join(F.broadcast(before), "_part")
    return placed.withColumn("box", F.floor((F.col("_before") + F.col("_running")) * parts / F.col("_total"))).drop("_part", "_running", "_before", "_total")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with a place from 1 on in an order that tells all rows apart: rows are sorted by ranges, numbered within their partition, and moved on by
    the numbers of rows in the partitions before (one row a partition)."""
    from ..sources.staging import scratch, written

    at = F.monotonically_increasing_id()
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), scratch(df.sparkSession, "numbered"), "rows")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")
