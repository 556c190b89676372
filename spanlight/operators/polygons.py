"""Union of polygons as joins over their sides, and their simplification.

Sides are cut where they cross or touch (they meet by an equi-join on those cells of a grid, finer where it is crowded, that no polygon holds whole). A piece belongs to the union's boundary if no
other polygon holds it and no piece runs back along it. Pieces follow each other where they share an end, and rings are told apart and put in order by
pointers that double their reach each round; no polygon or ring is gathered in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as g
from ..sources.staging import removed, scratch, written

#: Places are told apart from this distance on.
TOLERANCE = 1e-6


def _cells(df: DataFrame, size: float, ends: tuple[str, str, str, str]) -> DataFrame:
    """df with the cells (_i, _j) that a side runs through, row by row."""
    ax, ay, bx, by = (F.col(c) for c in ends)
    at = lambda v: F.floor(v / F.lit(size))
    rows = df.withColumn("_j", F.explode(F.sequence(at(F.least(ay, by)), at(F.greatest(ay, by)))))
    low, high = F.greatest(F.col("_j") * size, F.least(ay, by)), F.least((F.col("_j") + 1) * size, F.greatest(ay, by))
    x = lambda y: F.when(by == ay, None).otherwise(ax + (bx - ax) * ((y - ay) / (by - ay)))
    left, right = F.least(F.coalesce(x(low), ax), F.coalesce(x(high), bx)), F.greatest(F.coalesce(x(low), ax), F.coalesce(x(high), bx))
    slack = size * 1e-9 + TOLERANCE
    return rows.withColumn("_i", F.explode(F.sequence(at(left - slack), at(right + slack))))


def sides(polygons: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """polygons (id, ring: array of x, y; open or closed) -> poly, ax, ay, bx, by, each ring turning left, on the tolerance's grid, without sides of no length."""
    snap = lambda v: F.round(v / F.lit(tolerance)) * F.lit(tolerance)
    ring = F.transform("ring", lambda p: F.struct(snap(p["x"].cast("double")).alias("x"), snap(p["y"].cast("double")).alias("y")))
    turned = polygons.select(F.col("id").alias("poly"), ring.alias("ring")).where("size(ring) > 2 AND NOT exists(ring, p -> p.x IS NULL OR p.y IS NULL)")
    pairs = F.transform(F.sequence(F.lit(1), F.size("ring")), lambda i: F.struct(F.element_at("ring", i).alias("a"), F.element_at("ring", i % F.size("ring") + 1).alias("b")))
    area = F.aggregate(pairs, F.lit(0.0), lambda s, e: s + (e["a"]["x"] - F.element_at("ring", 1)["x"]) * (e["b"]["y"] - F.element_at("ring", 1)["y"]) - (e["b"]["x"] - F.element_at("ring", 1)["x"]) * (e["a"]["y"] - F.element_at("ring", 1)["y"]))
    each = turned.withColumns({"_area": area, "_pairs": pairs}).where("_area <> 0").select("poly", "_area", F.explode("_pairs").alias("e"))
    ahead = F.col("_area") > 0
    return each.select("poly", *[F.when(ahead, F.col(f"e.{p}.{c}")).otherwise(F.col(f"e.{q}.{c}")).alias(f"{p}{c}") for p, q in (("a", "b"), ("b", "a")) for c in "xy"]).where("ax <> bx OR ay <> by")


def live_cells(polygons: DataFrame, all_sides: DataFrame, base: str, tolerance: float = TOLERANCE, most: int = 16) -> DataFrame:
    """_l, _i, _j, _size and side, poly, ax ... by: the cells that no polygon holds whole, with the sides that run through them. Cells of level l have an edge of the polygons' mean
    extent / 2^l; those with sides of more than ``most`` polygons are quartered. The union's boundary lies in these cells alone: a dense heap of polygons keeps its rim."""
    box = polygons.select(F.col("id").alias("poly"), "ring", *[f(F.col("ring")[c]).alias(f"_{c}{n}") for c in "xy" for f, n in ((F.array_min, 1), (F.array_max, 2))])
    size = float(box.agg(F.avg(F.greatest(F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")))).first()[0] or 1.0)
    at, ends = lambda c: F.floor(F.col(c) / F.lit(size)), ("ax", "ay", "bx", "by")
    inner = box.withColumn("_i", F.explode(F.sequence(at("_x1"), at("_x2")))).withColumn("_j", F.explode(F.sequence(at("_y1"), at("_y2")))).select("_i", "_j", "poly")
    run = written(_cells(all_sides, size, ends).select("_i", "_j", "side", "poly", *ends).distinct(), base, "run-0")
    rings_, level, out = polygons.select(F.col("id").alias("poly"), "ring"), 0, None
    while True:
        edge = size / (1 << level)
        middle = [(F.col(c) + 0.5) * edge for c in ("_i", "_j")]
        held = inner.join(run.select("_i", "_j", "poly").distinct(), ["_i", "_j", "poly"], "left_anti").join(rings_, "poly").where(g.in_polygon(*middle, F.col("ring"))).select("_i", "_j").distinct()
        open_ = written(run.join(held, ["_i", "_j"], "left_anti"), base, f"open-{level}")
        heavy = open_.groupBy("_i", "_j").agg(F.countDistinct("poly").alias("n")).where(F.col("n") > most).select("_i", "_j")
        heavy = heavy if level < 20 and edge > 256 * tolerance else heavy.limit(0)
        heavy = written(heavy, base, f"heavy-{level}")
        here = open_.join(heavy, ["_i", "_j"], "left_anti").select(F.lit(level).alias("_l"), F.lit(edge).alias("_size"), "_i", "_j", "side", "poly", *ends)
        out = here if out is None else out.unionByName(here)
        if heavy.isEmpty():
            return written(out, base, "live")
        quarters = F.explode(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in (0, 1) for v in (0, 1)])).alias("q")
        down = [(F.col(c) * 2 + F.col(f"q.{k}")).alias(c) for c, k in (("_i", "u"), ("_j", "v"))]
        down_from = open_.join(heavy, ["_i", "_j"], "left_semi")
        inner = down_from.select("_i", "_j", "poly").distinct().select("_i", "_j", "poly", quarters).select(*down, "poly")
        level += 1
        child = down_from.select("_i", "_j", "side", "poly", *ends, quarters).select(*down, "side", "poly", *ends)
        run = written(child.where(_meets(size / (1 << level), tolerance)), base, f"run-{level}")


def _meets(edge: float, tolerance: float) -> Column:
    """Whether a side (ax, ay, bx, by) meets its cell (_i, _j), or comes within a small slack of it."""
    slack = edge * 1e-9 + 2 * tolerance
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    x1, x2, y1, y2 = F.col("_i") * edge - slack, (F.col("_i") + 1) * edge + slack, F.col("_j") * edge - slack, (F.col("_j") + 1) * edge + slack
    beside = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x1, x2) for y in (y1, y2)]
    return (F.greatest(ax, bx) >= x1) & (F.least(ax, bx) <= x2) & (F.greatest(ay, by) >= y1) & (F.least(ay, by) <= y2) & (F.least(*beside) <= 0) & (F.greatest(*beside) >= 0)


def pieces(all_sides: DataFrame, live: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Sides (with side, a number) that run through live cells, cut at all places there where they cross or touch those of other polygons."""
    ends, place_ = ("ax", "ay", "bx", "by"), ["_l", "_i", "_j"]
    placed = live
    all_sides = all_sides.join(live.select("side").distinct(), "side", "left_semi")
    other = placed.select(*place_, F.col("side").alias("o_side"), F.col("poly").alias("o_poly"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    pairs = placed.join(other, place_).where("side < o_side AND poly <> o_poly").dropDuplicates(["side", "o_side"])
    v = {c: F.col(c) for c in (*ends, "cx", "cy", "dx", "dy")}

    def on(px: Column, py: Column, a: str, b: str) -> Column:
        """Whether a place lies on a side, ends included."""
        ux, uy = v[f"{b}x"] - v[f"{a}x"], v[f"{b}y"] - v[f"{a}y"]
        n = F.hypot(ux, uy)
        along = ((px - v[f"{a}x"]) * ux + (py - v[f"{a}y"]) * uy) / n
        return (F.abs((px - v[f"{a}x"]) * uy - (py - v[f"{a}y"]) * ux) / n <= tolerance) & along.between(-tolerance, n + tolerance)

    touch = [(s, e, on(v[f"{e}x"], v[f"{e}y"], *s)) for s, es in (("ab", "cd"), ("cd", "ab")) for e in es]
    meet = g.line_intersection(*[v[c] for c in (*ends, "cx", "cy", "dx", "dy")])
    snap = lambda c: F.round(c / F.lit(tolerance)) * F.lit(tolerance)
    crosses = g.segments_cross(*[v[c] for c in (*ends, "cx", "cy", "dx", "dy")])
    for *_, t in touch:
        crosses = crosses & ~t
    place = lambda s, c, px, py: F.when(c, F.struct((F.col("side") if s == "ab" else F.col("o_side")).alias("side"), px.alias("x"), py.alias("y")))
    cuts = [place(s, t, v[f"{e}x"], v[f"{e}y"]) for s, e, t in touch] + [place(s, crosses, snap(meet["x"]), snap(meet["y"])) for s in ("ab", "cd")]
    found = pairs.select(F.explode(F.filter(F.array(*cuts), lambda c: c.isNotNull())).alias("c")).select("c.*")
    own = all_sides.select("side", F.explode(F.array(*[F.struct(F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")) for e in "ab"])).alias("c")).select("side", "c.*")
    points = found.unionByName(own).distinct().join(all_sides, "side")
    along = (F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("by") - F.col("ay"))
    order = Window.partitionBy("side").orderBy(along, "x", "y")
    cut = points.select("poly", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(order).alias("bx"), F.lead("y").over(order).alias("by"))
    return cut.where("bx IS NOT NULL AND (ax <> bx OR ay <> by)")


def boundary(polygons: DataFrame, cut: DataFrame, live: DataFrame) -> DataFrame:
    """ax, ay, bx, by of the pieces that bound the union, which lies to their left."""
    ahead = (F.col("ax") < F.col("bx")) | (F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by"))
    line = [F.when(ahead, F.col(p)).otherwise(F.col(q)).alias(n) for n, p, q in (("x1", "ax", "bx"), ("y1", "ay", "by"), ("x2", "bx", "ax"), ("y2", "by", "ay"))]
    lines = cut.select("poly", *line, ahead.alias("ahead"))
    key = ["x1", "y1", "x2", "y2"]
    one_way = lines.groupBy(*key).agg(F.max("ahead").alias("ahead"), F.min("ahead").alias("least")).where("ahead = least").drop("least")
    # a piece whose middle is in no live cell is held; in a live one only the polygons whose sides run through it may hold a piece
    middle = one_way.withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y2")) / 2})
    sizes = sorted({(r["_l"], r["_size"]) for r in live.select("_l", "_size").distinct().collect()})  # a row a level
    if not sizes:
        return cut.limit(0).select("ax", "ay", "bx", "by")
    levels = F.explode(F.array(*[F.struct(F.lit(l).alias("_l"), F.floor(F.col("x") / F.lit(s)).alias("_i"), F.floor(F.col("y") / F.lit(s)).alias("_j")) for l, s in sizes])).alias("c")
    placed = middle.select("*", levels).select(*middle.columns, "c.*")
    one_way = placed.join(live.select("_l", "_i", "_j").distinct(), ["_l", "_i", "_j"], "left_semi")
    near = one_way.join(live.select("_l", "_i", "_j", "poly").distinct(), ["_l", "_i", "_j"]).join(polygons.select(F.col("id").alias("poly"), "ring"), "poly")
    held = near.join(lines.select("poly", *key).distinct(), ["poly", *key], "left_anti").where(g.in_polygon(F.col("x"), F.col("y"), F.col("ring"))).select(*key).distinct()
    free = one_way.join(held, key, "left_anti")
    return free.select(*[F.when(F.col("ahead"), F.col(p)).otherwise(F.col(q)).alias(n) for n, p, q in (("ax", "x1", "x2"), ("ay", "y1", "y2"), ("bx", "x2", "x1"), ("by", "y2", "y1"))])


def rings(edges: DataFrame, base: str) -> DataFrame:
    """Directed edges (ax, ay, bx, by) that close -> ring, place (from 1 on), x, y. Where several go on from a place, the one most to the right of the way back
    is next, so regions that only touch stay apart."""
    numbered = written(edges.withColumn("edge", F.monotonically_increasing_id()), base, "edges")
    after = numbered.select(F.col("edge").alias("next"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("nx"), F.col("by").alias("ny"))
    back, ahead = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx")), F.atan2(F.col("ny") - F.col("by"), F.col("nx") - F.col("bx"))
    turn = F.pmod(back - ahead, F.lit(2 * math.pi))  # clockwise from the way back
    turn = F.when(turn < 1e-12, F.lit(2 * math.pi)).otherwise(turn)
    state = numbered.join(after, ["bx", "by"]).groupBy("edge").agg(F.min_by("next", turn).alias("next"))
    start = written(state, base, "next")
    # the least edge of each ring
    seen, i = written(start.select("edge", F.col("next").alias("to"), F.least("edge", "next").alias("ring")), base, "seen-0"), 0
    while True:
        far = seen.select(F.col("edge").alias("to"), F.col("to").alias("_to"), F.col("ring").alias("_ring"))
        new = written(seen.join(far, "to").select("edge", F.col("_to").alias("to"), F.least("ring", "_ring").alias("ring"), (F.col("_ring") < F.col("ring")).alias("moved")), base, f"seen-{i + 1}")
        removed(numbered.sparkSession, base, f"seen-{i}")
        done, seen, i = new.where("moved").isEmpty(), new.drop("moved"), i + 1
        if done:
            break
    # steps from each edge to the end of its ring, which goes before the least edge
    head = start.join(seen.select("edge", "ring"), "edge")
    left, i = written(head.select("edge", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("to"), F.when(F.col("next") != F.col("ring"), 1).otherwise(0).cast("long").alias("steps")), base, "left-0"), 0
    while not left.where("to IS NOT NULL").isEmpty():
        far = left.select(F.col("edge").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        left = written(left.join(far, "to", "left").select("edge", "ring", F.col("_to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")), base, f"left-{i + 1}")
        removed(numbered.sparkSession, base, f"left-{i}")
        i += 1
    size = left.groupBy("ring").agg(F.count(F.lit(1)).alias("n"))
    return left.join(size, "ring").join(numbered, "edge").select("ring", (F.col("n") - F.col("steps")).alias("place"), F.col("ax").alias("x"), F.col("ay").alias("y"))


def union(polygons: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """polygons (id, ring: array of structs x, y, simple) -> the rings of their union: ring, place, x, y; outer ones turn left, holes right. Places nearer than the
    tolerance are one. Equal polygons count once; rings of no area, or with a null, have no part in it."""
    base = scratch(polygons.sparkSession, "union")
    snap = lambda c: F.round(c.cast("double") / F.lit(tolerance)) * F.lit(tolerance)
    one = polygons.select("id", F.transform("ring", lambda p: F.struct(snap(p["x"]).alias("x"), snap(p["y"]).alias("y"))).alias("ring")).groupBy("ring").agg(F.min("id").alias("id"))
    own = written(one, base, "polygons")
    all_sides = written(sides(own, tolerance).withColumn("side", F.monotonically_increasing_id()), base, "sides")
    live = live_cells(own, all_sides, base, tolerance)
    cut = written(pieces(all_sides, live, tolerance), base, "pieces")
    return rings(boundary(own, cut, live), base)


def ring_areas(found: DataFrame) -> DataFrame:
    """ring, n, area: positive for outer rings, negative for holes."""
    order = Window.partitionBy("ring").orderBy("place")
    first = found.where("place = 1").select("ring", F.col("x").alias("x0"), F.col("y").alias("y0"))
    moved = found.join(first, "ring").select("ring", "place", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"))
    cross = F.col("x") * F.coalesce(F.lead("y").over(order), F.lit(0.0)) - F.coalesce(F.lead("x").over(order), F.lit(0.0)) * F.col("y")
    return moved.withColumn("cross", cross).groupBy("ring").agg(F.count(F.lit(1)).alias("n"), (F.sum("cross") / 2).alias("area"))


def corners(found: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """The ring's places at which it turns."""
    order = Window.partitionBy("ring").orderBy("place")
    whole = Window.partitionBy("ring").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = found.withColumns({f"_p{c}": F.coalesce(F.lag(c).over(order), F.last(c).over(whole)) for c in "xy"} | {f"_n{c}": F.coalesce(F.lead(c).over(order), F.first(c).over(whole)) for c in "xy"})
    ux, uy, vx, vy = F.col("x") - F.col("_px"), F.col("y") - F.col("_py"), F.col("_nx") - F.col("x"), F.col("_ny") - F.col("y")
    return near.where(F.abs(ux * vy - uy * vx) > tolerance * F.hypot(ux, uy) * F.hypot(vx, vy)).select(*found.columns)


def simplified(ring: Column, distance: float) -> Column:
    """The places of a ring without those that lie nearer than a distance to one kept before."""
    near = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]) < distance * distance
    return F.aggregate(ring, F.filter(ring, lambda p: F.lit(False)), lambda kept, p: F.when(F.exists(kept, lambda q: near(p, q)), kept).otherwise(F.concat(kept, F.array(p))))
