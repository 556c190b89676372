"""Meshes as tables of triangles: cut by any number of planes in turn, with normals kept along the cuts, and measured.

A triangle's piece is an array of corners (x, y, z, nx, ny, nz) that planes cut in one fold, so a row stays a row until it is taken apart again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

CORNER = ("x", "y", "z", "nx", "ny", "nz")


def plane(normal: Sequence[float], through: Sequence[float]) -> tuple[float, ...]:
    """a, b, c, d of the half space a x + b y + c z >= d on the side that the normal points to."""
    return (*map(float, normal), float(sum(n * p for n, p in zip(normal, through))))


def box_planes(low: Sequence[float], high: Sequence[float]) -> list[tuple[float, ...]]:
    """The six half spaces of a box along the axes."""
    unit = [[float(i == k) for i in range(3)] for k in range(3)]
    return [plane(u, low) for u in unit] + [plane([-v for v in u], high) for u in unit]


def turned_box_planes(middle: Sequence[float], axes: Sequence[Sequence[float]], halves: Sequence[float]) -> list[tuple[float, ...]]:
    """The six half spaces of a box with axes of its own (unit vectors) and half sides."""
    out = []
    for a, h in zip(axes, halves):
        for s in (1.0, -1.0):
            out.append(plane([-s * v for v in a], [m + s * h * v for m, v in zip(middle, a)]))
    return out


def corner(x: Column, y: Column, z: Column, normal: Sequence[Column] | None = None) -> Column:
    """A corner as an array; without a normal zeros stand for it."""
    return F.array(*[c.cast("double") for c in (x, y, z, *(normal or [F.lit(0.0)] * 3))])


def cut(ring: Column, planes: Sequence[Sequence[float]]) -> Column:
    """What the half spaces leave of a convex ring of corners, as a ring in the same direction; an empty array where nothing is left. At a cut the place and the normal lie
    between those of both corners; the normal is made a unit again unless it vanishes. Corners on a plane stay. A ring with a null place becomes null."""

    def height(p: Column, c: Column) -> Column:
        return p[0] * c[0] + p[1] * c[1] + p[2] * c[2] - p[3]

    def between(a: Column, b: Column, ha: Column, hb: Column) -> Column:
        at = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda v: v["a"] + (v["b"] - v["a"]) * (ha / (ha - hb)))
        return F.transform(F.array(at), lambda q: F.transform(q, lambda v, i: F.when(i < 3, v).otherwise(v / F.coalesce(F.nullif(F.sqrt(q[3] * q[3] + q[4] * q[4] + q[5] * q[5]), F.lit(0.0)), F.lit(1.0)))))

    def once(now: Column, p: Column) -> Column:
        # Each corner beside the one after it and both heights: heights are counted once a corner, not once a use.
        high = F.transform(now, lambda c: F.struct(c.alias("c"), height(p, c).alias("h")))
        after = F.concat(F.slice(high, 2, F.greatest(F.size(high) - 1, F.lit(0))), F.slice(high, 1, 1))
        none = F.array().cast("array<array<double>>")
        return F.flatten(F.transform(F.arrays_zip(high.alias("u"), after.alias("v")), lambda s: F.concat(
            F.when(s["u"]["h"] >= 0, F.array(s["u"]["c"])).otherwise(none),
            F.when((s["u"]["h"] > 0) & (s["v"]["h"] < 0) | (s["u"]["h"] < 0) & (s["v"]["h"] > 0), between(s["u"]["c"], s["v"]["c"], s["u"]["h"], s["v"]["h"])).otherwise(none))))

    whole = F.forall(ring, lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v)))
    return F.when(whole, F.aggregate(F.array(*[F.array(*map(F.lit, map(float, p))) for p in planes]), ring, once))


def fan(ring: Column) -> Column:
    """Triangles (arrays of three corners) of a convex ring, all from its first corner; none of fewer than three corners."""
    return F.when(F.size(ring) < 3, F.array().cast("array<array<array<double>>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ring) - 2, F.lit(1))), lambda i: F.array(ring[0], F.get(ring, i), F.get(ring, i + 1))))


def clipped(triangles: DataFrame, ring: str, planes: Sequence[Sequence[float]]) -> DataFrame:
    """The mesh's triangles (column ``ring``: three corners) within all half spaces, each piece as triangles again; other columns are kept."""
    rest = [c for c in triangles.columns if c != ring]
    pieces = triangles.withColumn(ring, cut(F.col(ring), planes)).where(F.size(ring) > 2)
    return pieces.select(*rest, F.explode(fan(F.col(ring))).alias(ring))


def _cross(u, v):
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def area(ring: Column) -> Column:
    """Area of a convex ring; 0 of an empty one."""

    def of(t: Column) -> Column:
        n = _cross(*[[t[k][i] - t[0][i] for i in range(3)] for k in (1, 2)])
        return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2

    return F.aggregate(fan(ring), F.lit(0.0), lambda s, t: s + of(t))


def volume_share(ring: Column, middle: Sequence[float] = (0.0, 0.0, 0.0)) -> Column:
    """The signed volume between a ring and a place; over a closed mesh's outward triangles the sum is its volume, wherever the place."""

    def of(t: Column) -> Column:
        a, b, c = ([t[k][i] - float(middle[i]) for i in range(3)] for k in range(3))
        n = _cross(b, c)
        return (a[0] * n[0] + a[1] * n[1] + a[2] * n[2]) / 6

    return F.aggregate(fan(ring), F.lit(0.0), lambda s, t: s + of(t))
