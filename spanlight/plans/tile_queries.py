"""Queries of tiles along a corridor."""

from pyspark.sql import functions as F

from ..operators import tiles as t
from ..sources.points import points
from .registry import query


@query("p12_tile_groups")
def p12_tile_groups(spark, sf):
    """Groups of tiles of 25 m from the lower left corner on and their directions, with y at a twentieth so that the cloud is a corridor; tested against a plain loop."""
    at = points(spark, sf).withColumn("y", F.col("y") / 20)
    p = at.groupBy(F.floor(F.col("x") / 25.0).alias("tx"), F.floor(F.col("y") / 25.0).alias("ty"))
    boxes = p.agg(*[(F.min if k == "1" else F.max)(c).alias(c + k) for c in "xy" for k in "12"])
    tiles = boxes.select((F.col("tx") * 1_000_000 + F.col("ty")).alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), "x1", "y1", "x2", "y2")
    return t.group_directions(t.tile_groups(tiles, "id", (0.0, 0.0), 75.0)).select("group", "n", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "ux", "uy")])
