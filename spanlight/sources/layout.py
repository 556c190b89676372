"""A stored layout of points that polygon and box queries prune: files follow a space-filling curve, a catalogue has each file's box, and within a
file row groups follow the curve too, so their statistics skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as g
from ..operators import filters

#: Points of a file, and bytes of its row groups.
FILE_POINTS, GROUP_BYTES = 5_000_000, 8 << 20
BITS = 24
CATALOGUE = "_boxes"
# Masks that keep 1 of 2 bits, by the number of bits that stay together.
MASKS = {16: 0x0000FFFF0000FFFF, 8: 0x00FF00FF00FF00FF, 4: 0x0F0F0F0F0F0F0F0F, 2: 0x3333333333333333, 1: 0x5555555555555555}


def curve_place(x: Column, y: Column, box: tuple[float, float, float, float], bits: int = BITS) -> Column:
    """The place of a point along a Z curve over a box (x1, y1, x2, y2): the bits of both axes in turn."""

    def spread(v: Column, low: float, high: float) -> Column:
        share = (v - low) / F.lit((high - low) or 1.0)
        out = F.least(F.greatest(F.floor(share * F.lit(float(1 << bits))), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
        for together, mask in MASKS.items():
            out = out.bitwiseOR(F.shiftleft(out, together)).bitwiseAND(F.lit(mask))
        return out

    return spread(x, box[0], box[2]).bitwiseOR(F.shiftleft(spread(y, box[1], box[3]), 1))


def write_layout(df: DataFrame, path: str, file_points: int = FILE_POINTS, group_bytes: int = GROUP_BYTES) -> None:
    """Writes points (columns x, y and any others) along the curve, and the catalogue of file, n and box beside them. Points without x or y come first
    and are in no box, so no query by place finds them."""
    row = df.agg(F.count(F.lit(1)), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    box = tuple(float(v or 0.0) for v in row[1:])
    files = max(1, -(-row[0] // file_points))
    # the hash cuts places of very many points; the curve alone would leave them in one file
    placed = df.withColumns({"_place": curve_place(F.col("x"), F.col("y"), box), "_cut": F.xxhash64(*df.columns)})
    dealt = placed.repartitionByRange(files, "_place", "_cut").sortWithinPartitions("_place").drop("_place", "_cut")
    dealt.write.option("parquet.block.size", group_bytes).parquet(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    boxes = df.sparkSession.read.parquet(path).select(name.alias("file"), "x", "y").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))
    boxes.coalesce(1).write.parquet(f"{path}/{CATALOGUE}")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{CATALOGUE}")


def read_layout(spark: SparkSession, path: str, ring: g.Ring | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The stored points in a polygon, or in a box (closed), or all. Files whose box can't hold any aren't given to the scan, which skips row groups by the bounds
    of x and y; what is left is tested point by point. The driver holds the names of the files to be read, as for any scan."""
    everything = spark.read.parquet(path)
    if ring is None and box is None:
        return everything
    if ring is not None:
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        box = (min(xs), min(ys), max(xs), max(ys))
    table = catalogue(spark, path)
    meets = (F.col("xmin") <= box[2]) & (F.col("xmax") >= box[0]) & (F.col("ymin") <= box[3]) & (F.col("ymax") >= box[1])
    # a side along a box's edge crosses nothing, so boxes are looked at a little wider
    slack = 1e-9 * max(1.0, *map(abs, box))
    wider = table.where(meets).withColumns({c: F.col(c) + d * slack for c, d in (("xmin", -1), ("ymin", -1), ("xmax", 1), ("ymax", 1))})
    chosen = wider.where(filters.tile_may_meet(ring)) if ring is not None else wider
    names = [f"{path}/{r['file']}" for r in chosen.select("file").collect()]
    if not names:
        return everything.limit(0)
    found = spark.read.schema(everything.schema).parquet(*names)
    bounds = F.col("x").between(float(box[0]), float(box[2])) & F.col("y").between(float(box[1]), float(box[3]))
    return found.where(bounds & g.in_polygon(F.col("x"), F.col("y"), ring)) if ring is not None else found.where(bounds)
