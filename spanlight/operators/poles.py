"""Poles of distribution lines: narrow pieces of horizontal layers, linked where they overlap from layer to layer, make trunks; a trunk's axis labels its points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.staging import scratch, written
from . import graph


def layer_pieces(df: DataFrame, step: float, cell: float) -> DataFrame:
    """piece (a number), layer, area (of its cells), x1, y1, x2, y2, z1, z2, mx, my, n: in each layer of height ``step`` the points whose cells touch,
    diagonally too. Points with a null or NaN place are in no piece."""
    whole = df.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))
    placed = whole.select("x", "y", "z", F.floor(F.col("z") / step).alias("layer"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    grid = graph.Grid.of(placed, ("layer", "cx", "cy"))
    # Sums of a cell first, so that pieces of very many points meet as cells.
    cells = placed.withColumn("id", grid.id()).groupBy("id", "layer").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), *[f(c).alias(c + k) for c in "xyz" for k, f in (("1", F.min), ("2", F.max))])
    cells = written(cells, scratch(df.sparkSession, "pole-cells"), "cells")
    same = F.col("layer") == F.col("n_layer")
    parts = graph.components(cells.select("id"), graph.cell_edges(cells, grid, same, ("layer",)))
    return cells.join(parts, "id").groupBy(F.col("component").alias("piece"), "layer").agg(
        (F.count(F.lit(1)) * F.lit(cell * cell)).alias("area"), *[(F.min if k == "1" else F.max)(c + k).alias(c + k) for c in "xyz" for k in "12"],
        (F.sum("sx") / F.sum("n")).alias("mx"), (F.sum("sy") / F.sum("n")).alias("my"), F.sum("n").alias("n"))


def trunks(df: DataFrame, step: float, cell: float, most_area: float = 0.25, least_fill: float = 0.8, least_layers: int = 4) -> DataFrame:
    """trunk, layers, n, z1, z2, mx, my, mz, ux, uy, uz: chains of narrow pieces (area below ``most_area``, higher than ``least_fill`` steps) of adjoining layers whose
    boxes overlap, over at least ``least_layers`` layers. The axis goes through the middle of its pieces' middles along their regression on height. Where pieces fork,
    all of them belong to one trunk; its number is its least piece."""
    base = scratch(df.sparkSession, "trunks")
    narrow = written(layer_pieces(df, step, cell).where((F.col("area") < most_area) & (F.col("z2") - F.col("z1") > least_fill * step)), base, "pieces")
    # A narrow piece spans at most most_area / cell, so it lies in few buckets of that width.
    width = max(most_area / cell, cell)
    bucket = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    dealt = narrow.select("piece", "layer", "x1", "x2", "y1", "y2").withColumn("bx", bucket("x1", "x2")).withColumn("by", bucket("y1", "y2"))
    above = dealt.select((F.col("layer") - 1).alias("layer"), "bx", "by", F.col("piece").alias("v"), *[F.col(c).alias("n_" + c) for c in ("x1", "x2", "y1", "y2")])
    links = dealt.join(above, ["layer", "bx", "by"]).where("n_x1 <= x2 AND n_x2 >= x1 AND n_y1 <= y2 AND n_y2 >= y1").select(F.col("piece").alias("u"), "v").distinct()
    chains = graph.components(narrow.select(F.col("piece").alias("id")), links).select(F.col("id").alias("piece"), F.col("component").alias("trunk"))
    p = narrow.join(chains, "piece").withColumn("mz", (F.col("z1") + F.col("z2")) / 2)
    lean = lambda c: F.coalesce(F.covar_pop(c, "mz") / F.nullif(F.var_pop("mz"), F.lit(0.0)), F.lit(0.0))
    t = p.groupBy("trunk").agg(F.count_distinct("layer").alias("layers"), F.sum("n").alias("n"), F.min("z1").alias("z1"), F.max("z2").alias("z2"), F.avg("mx").alias("mx"), F.avg("my").alias("my"), F.avg("mz").alias("mz"), lean("mx").alias("lx"), lean("my").alias("ly"))
    size = F.sqrt(F.expr("lx * lx + ly * ly + 1"))
    return t.where(F.col("layers") >= least_layers).select("trunk", "layers", "n", "z1", "z2", "mx", "my", "mz", (F.col("lx") / size).alias("ux"), (F.col("ly") / size).alias("uy"), (1 / size).alias("uz"))


def pole_points(df: DataFrame, poles: DataFrame, radius: float, margin: float = 0.5) -> DataFrame:
    """df with trunk: of a trunk (at most ``margin`` beyond its ends) whose axis is nearer than ``radius``, the nearest (ties: the least); null elsewhere. Poles are few a place, points
    are many: each pole is copied to the columns of ground that its leaning axis can reach, and a cell's poles meet its points as one array, so no point is doubled."""
    edge = 2 * radius
    at = lambda z, m, u: F.col(m) + (F.col(z) - F.col("mz")) * F.col(u) / F.col("uz")
    reach = F.lit(radius) / F.col("uz") + F.lit(margin) / F.col("uz")
    span = lambda m, u: F.explode(F.sequence(F.floor((F.least(at("z1", m, u), at("z2", m, u)) - reach) / edge), F.floor((F.greatest(at("z1", m, u), at("z2", m, u)) + reach) / edge)))
    dealt = poles.withColumn("_bx", span("mx", "ux")).withColumn("_by", span("my", "uy"))
    near = dealt.groupBy("_bx", "_by").agg(F.sort_array(F.collect_list(F.struct("trunk", "z1", "z2", "mx", "my", "mz", "ux", "uy", "uz"))).alias("_near"))

    def gap(p):
        d = [F.col(c) - p["m" + c] for c in "xyz"]
        u = [p["u" + c] for c in "xyz"]
        n = [d[1] * u[2] - d[2] * u[1], d[2] * u[0] - d[0] * u[2], d[0] * u[1] - d[1] * u[0]]
        return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])

    inside = lambda p: (F.col("z") >= p["z1"] - margin) & (F.col("z") <= p["z2"] + margin)
    best = F.array_min(F.transform(F.filter("_near", lambda p: inside(p) & (gap(p) < radius)), lambda p: F.struct(gap(p).alias("d"), p["trunk"].alias("trunk"))))
    placed = df.withColumn("_bx", F.floor(F.col("x") / edge)).withColumn("_by", F.floor(F.col("y") / edge)).join(near, ["_bx", "_by"], "left")
    return placed.withColumn("trunk", best["trunk"]).drop("_bx", "_by", "_near")
