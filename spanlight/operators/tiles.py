"""Directions along a corridor of tiles: from a start, tiles join a group ring by ring until the group is long enough to tell a direction, and the next group
starts at its far end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.staging import removed, scratch, written


def tile_groups(tiles: DataFrame, key: str, start: Sequence[float], step: float, ratio: float = 3.0) -> DataFrame:
    """key, group (from 0): tiles (x, y their middles, x1, y1, x2, y2 their boxes) in the order in which they are reached. A ring holds the free tiles that are within
    k steps of the group's start in x and y and not within k - 1; rings join until the group's box is ``ratio`` times as long as wide, or nothing is free. A group's
    far end, the next start, is the middle farthest from its own start (ties: the greatest key); the first start is the middle nearest to ``start`` (ties: the least key).
    A group is one aggregate by ring, running bounds over the rings and one written table of what is left; rings are few, as they are numbered by distance.
    Tiles with a null place or box are left out; equal keys go together."""
    spark = tiles.sparkSession
    base = scratch(spark, "tile-groups")
    bounds = ("x1", "y1", "x2", "y2")
    left = written(tiles.select(key, "x", "y", *bounds).dropna(), base, "left-0")
    far = lambda p: (F.col("x") - p[0]) ** 2 + (F.col("y") - p[1]) ** 2
    first = left.agg(F.min(F.struct(far(start).alias("d"), F.col(key).alias("k"), "x", "y")).alias("m")).select("m.*").first()
    at, found, i = (first["x"], first["y"]), None, 0
    while at[0] is not None:
        ring = F.greatest(F.ceil(F.greatest(F.abs(F.col("x") - at[0]), F.abs(F.col("y") - at[1])) / F.lit(float(step))), F.lit(1))
        placed = left.withColumn("ring", ring)
        by_ring = placed.groupBy("ring").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
        # One row a ring, not a tile: the running bounds are over a table as short as the corridor is long in steps.
        upto = Window.orderBy("ring")
        grown = by_ring.select("ring", *[(F.min if c.endswith("1") else F.max)(c).over(upto).alias(c) for c in bounds])
        wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        last = grown.agg(F.min(F.when((wide * ratio < high) | (high * ratio < wide), F.col("ring"))).alias("end"), F.max("ring").alias("all")).first()
        end = last["end"] if last["end"] is not None else last["all"]
        group = written(placed.where(F.col("ring") <= end).withColumn("group", F.lit(i)).select(key, "group", "x", "y", F.lit(float(at[0])).alias("from_x"), F.lit(float(at[1])).alias("from_y"), *bounds), base, f"group-{i}")
        found = group if found is None else found.unionByName(group)
        next_ = group.agg(F.max(F.struct(far(at).alias("d"), F.col(key).alias("k"), "x", "y")).alias("m")).select("m.x", "m.y").first()
        i += 1
        left = written(placed.where(F.col("ring") > end).drop("ring"), base, f"left-{i}")
        removed(spark, base, f"left-{i - 1}")
        at = (next_["x"], next_["y"]) if not left.isEmpty() else (None, None)
    return found if found is not None else left.select(key, F.lit(0).alias("group"), "x", "y", F.lit(0.0).alias("from_x"), F.lit(0.0).alias("from_y"), *bounds)


def group_directions(groups: DataFrame) -> DataFrame:
    """group, n, x1, y1, x2, y2 (its box) and ux, uy: the main direction of its tiles' middles, away from where the group started; of one tile, or tiles all at one place, (1, 0)."""
    m = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[(F.min if c.endswith("1") else F.max)(c).alias(c) for c in ("x1", "y1", "x2", "y2")], F.avg("x").alias("mx"), F.avg("y").alias("my"),
                                    F.first("from_x").alias("fx"), F.first("from_y").alias("fy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    turn = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    ux, uy = F.cos(turn), F.sin(turn)
    side = F.when((F.col("mx") - F.col("fx")) * ux + (F.col("my") - F.col("fy")) * uy < 0, -1.0).otherwise(1.0)
    return m.select("group", "n", "x1", "y1", "x2", "y2", (ux * side).alias("ux"), (uy * side).alias("uy"))
