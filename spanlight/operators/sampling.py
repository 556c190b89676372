"""Sampling and arg-max selections of point relations."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import scratch, written


def cell_tops(df: DataFrame, size: float, key: Sequence[str]) -> DataFrame:
    """The highest point of each cell, of equals the one with the least key."""
    best = F.min(F.struct((-F.col("z")).alias("_z"), *key))
    tops = df.groupBy(F.floor(F.col("x") / F.lit(float(size))).alias("cx"), F.floor(F.col("y") / F.lit(float(size))).alias("cy")).agg(best.alias("t"))
    return tops.select("cx", "cy", *[F.col(f"t.{k}") for k in key], (-F.col("t._z")).alias("z"))


def random_sample(df: DataFrame, n: int, key: Sequence[str], seed: int) -> DataFrame:
    """n rows without replacement, the same for the same seed: the least hashes of the key."""
    text = F.concat(F.lit(str(seed)), F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return df.orderBy(F.md5(text.cast("binary")), *key).limit(n)


def pyramid(tiles: DataFrame, luck: str, levels: int, share: float, least: int) -> DataFrame:
    """Points with px, py of their tile and ``luck``, an even key -> level, px, py, luck: on each level a node keeps a share of what its children keep, those with
    the least keys, or all if they are up to ``least``. Ranks are by ranges of keys within a node (a hot node is the sum of its sorted pieces), not by one sort of the node: the
    rank of a point is the number of points of its node in lower ranges, from a table of counts, and its place within its range."""
    out = level = tiles.select(F.lit(0).alias("level"), "px", "py", luck)
    for k in range(1, levels):
        node = level.select(F.floor(F.col("px") / 2).alias("px"), F.floor(F.col("py") / 2).alias("py"), luck, F.substring(luck, 1, 3).alias("range"))
        counts = node.groupBy("px", "py", "range").agg(F.count(F.lit(1)).alias("m"))
        order = Window.partitionBy("px", "py").orderBy("range")
        below = counts.select("px", "py", "range", (F.sum("m").over(order) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("px", "py")).alias("n"))
        rank = F.row_number().over(Window.partitionBy("px", "py", "range").orderBy(luck)) + F.col("before")
        kept = node.join(below, ["px", "py", "range"]).withColumn("rank", rank).where((F.col("n") <= least) | (F.col("rank") <= F.floor(F.col("n") * share)))
        level = kept.select(F.lit(k).alias("level"), "px", "py", luck)
        out = out.unionByName(level)
    return out


def subtrees(tiles: DataFrame, levels: int) -> DataFrame:
    """tiles (tx, ty, n) -> level, px, py of every node of the pyramid, with the number of tiles below it (itself included) and of their points."""
    node = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.struct(k.alias("level"), F.floor(F.col("tx") / F.pow(F.lit(2.0), k)).alias("px"), F.floor(F.col("ty") / F.pow(F.lit(2.0), k)).alias("py"))))
    return tiles.select("n", node.alias("node")).groupBy("node.level", "node.px", "node.py").agg(F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("n"))


def farthest_points(df: DataFrame, block: str, key: str, n: int) -> DataFrame:
    """Up to n points of each block with their rank, each the farthest from those before (ties: the least key); starts at the least key. A round joins points to the
    few chosen of their block and takes one maximum a block, so blocks may be of any size; the chosen ones of a round are written."""
    base, at = scratch(df.sparkSession, "farthest"), F.struct("x", "y", "z", key)
    chosen = written(df.groupBy(block).agg(F.array(F.min_by(at, key)).alias("chosen")), base, "chosen-0")
    for i in range(1, n):
        d2 = F.array_min(F.transform("chosen", lambda c: (F.col("x") - c["x"]) * (F.col("x") - c["x"]) + (F.col("y") - c["y"]) * (F.col("y") - c["y"]) + (F.col("z") - c["z"]) * (F.col("z") - c["z"])))
        far = df.select(block, "x", "y", "z", key).join(chosen, block).select(block, d2.alias("d2"), at.alias("at"))
        top = far.groupBy(block).agg(F.max("d2").alias("_d2"))
        best = far.join(top.where("_d2 > 0"), block).where("d2 = _d2").groupBy(block).agg(F.min_by("at", F.col(f"at.{key}")).alias("next"))
        chosen = written(chosen.join(best, block, "left").select(block, F.when(F.col("next").isNull(), F.col("chosen")).otherwise(F.array_append("chosen", F.col("next"))).alias("chosen")), base, f"chosen-{i}")
    return chosen.select(block, F.posexplode("chosen").alias("rank", "at")).select(block, F.col(f"at.{key}").alias(key), (F.col("rank") + 1).cast("int").alias("rank"))


def triangle_area(a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> Column:
    u, v = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2


def mesh_samples(df: DataFrame, key: str, a, b, c, per_area: float, seed: int = 1, noise: Callable | None = None) -> DataFrame:
    """Points spread evenly over triangles: area times density of them each, at barycentric places from a hash. noise: a callback from a sample's columns x, y, z and
    from luck(k), even numbers in [0, 1) of its own for k = 0, 1, ..., to what is added to x, y and z."""
    n = F.floor(triangle_area(a, b, c) * F.lit(per_area)).cast("int")
    corners = [x.alias(f"_{k}{i}") for k, p in zip("abc", (a, b, c)) for i, x in enumerate(p)]
    rows = df.select(key, *corners, n.alias("_n")).where("_n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    luck = lambda k: F.pmod(F.xxhash64(F.lit(seed), key, "i", F.lit(k)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    u, v = F.sqrt(luck(1)), luck(2)
    at = [(1 - u) * F.col(f"_a{i}") + u * (1 - v) * F.col(f"_b{i}") + u * v * F.col(f"_c{i}") for i in range(3)]
    if noise is None:
        return rows.select(key, "i", *[x.alias(name) for x, name in zip(at, "xyz")])
    placed = rows.select(key, "i", *[x.alias(name) for x, name in zip(at, "xyz")])
    moves = noise({name: F.col(name) for name in "xyz"}, lambda k: luck(k + 3))
    return placed.select(key, "i", *[(F.col(name) + d).alias(name) for name, d in zip("xyz", moves)])


def sequential_sample(df: DataFrame, n: int, key: Sequence[str], seed: int) -> DataFrame:
    """``random_sample`` in the order of the key."""
    return random_sample(df, n, key, seed).orderBy(*key)


def chains(df: DataFrame, by: str, key: str, most: float) -> DataFrame:
    """by, key, place: rows of each line in a chain. It starts at the least key and takes the nearest open row within ``most`` of its last one (ties: the lesser
    key), then goes on the same way from its first row; place 1 is the end reached last. Rows beyond reach have none. A line's rows are a few towers or spans."""
    import pandas as pd

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        x, y, ids = rows["x"].tolist(), rows["y"].tolist(), rows[key].tolist()
        places = [i for i in range(len(ids)) if x[i] == x[i] and y[i] == y[i]]
        width = max((max(v[i] for i in places) - min(v[i] for i in places) for v in (x, y)), default=0.0)
        size = min(most, max(width / (len(ids) / 2) ** 0.5, most / 64)) or 1.0  # about two rows a cell, and at most 64 rings of cells within reach
        cell = lambda i: (math.floor(x[i] / size), math.floor(y[i] / size))
        open_: dict = {}
        for i in places:
            if i:
                open_.setdefault(cell(i), []).append(i)

        def closest(j: int) -> tuple:
            """The squared distance and the number of the nearest open row: rings of cells around j's, until none nearer can come."""
            best, ring, (a, b) = (math.inf, -1), 0, cell(j)
            while ring - 1 <= most / size and ((ring - 1) * size * (1 - 1e-9)) ** 2 <= best[0]:
                edge = range(-ring, ring + 1)
                around = {(u, v) for u in edge for v in ((-ring, ring) if abs(u) < ring else edge)}
                for u, v in around:
                    for i in open_.get((a + u, b + v), ()):
                        best = min(best, ((x[i] - x[j]) * (x[i] - x[j]) + (y[i] - y[j]) * (y[i] - y[j]), i))
                ring += 1
            return best

        out = deque([0])
        for end in (-1, 0):
            while open_ and x[out[end]] == x[out[end]] and y[out[end]] == y[out[end]]:
                d, i = closest(out[end])
                if not d <= most * most:
                    break
                open_[cell(i)].remove(i)
                if not open_[cell(i)]:
                    del open_[cell(i)]
                (out.append if end else out.appendleft)(i)
        return pd.DataFrame({by: rows[by].iloc[0], key: [ids[i] for i in out], "place": range(1, len(out) + 1)})

    kinds = dict(df.dtypes)
    return df.select(by, key, "x", "y").groupBy(by).applyInPandas(chain, f"{by} {kinds[by]}, {key} {kinds[key]}, place int")


def split_nodes(df: DataFrame, tile: float, most: int, levels: int) -> DataFrame:
    """df with node: the path of halves that each point's tile is split into, at the middle of the longest side of a node's box (x before y before z), until
    no node has more than ``most`` points or ``levels`` is reached. A level is one sum over nodes and one join, and is written."""
    base = scratch(df.sparkSession, "nodes")
    start = F.concat_ws("_", F.floor(F.col("x") / tile), F.floor(F.col("y") / tile))
    out = df.withColumn("node", F.concat(start, F.lit(":")))
    for i in range(levels):
        boxes = out.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_{c}{k}") for c in "xyz" for k, f in (("1", F.min), ("2", F.max))]).where(F.col("_n") > most)
        sides = [F.col(f"_{c}2") - F.col(f"_{c}1") for c in "xyz"]
        longest = F.greatest(*sides)
        boxes = boxes.where(longest > 0).select("node", *[((F.col(f"_{c}1") + F.col(f"_{c}2")) / 2).alias(f"_m{c}") for c in "xyz"], F.when(sides[0] == longest, 0).when(sides[1] == longest, 1).otherwise(2).alias("_axis"))
        boxes = written(boxes, base, f"boxes-{i}")
        if boxes.isEmpty():
            break
        side = F.when(F.col("_axis") == 0, F.col("x") >= F.col("_mx")).when(F.col("_axis") == 1, F.col("y") >= F.col("_my")).otherwise(F.col("z") >= F.col("_mz"))
        half = F.when(F.col("_axis").isNull(), "").when(side, "1").otherwise("0")
        out = written(out.join(boxes, "node", "left").withColumn("node", F.concat("node", half)).select(*df.columns, "node"), base, f"points-{i}")
    return out
