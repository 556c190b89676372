"""Plane and space geometry as column expressions. Rings given as Python lists become plain arithmetic in generated code; rings
in columns (arrays of structs x, y) use higher-order functions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

Ring = Sequence[tuple[float, float]]


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def edges(ring: Ring) -> list[tuple[float, float, float, float]]:
    """(x1, y1, x2, y2) of a ring's sides."""
    return [(*a, *b) for a, b in zip(ring, [*ring[1:], ring[0]])]


def _crossing(x, y, x1, y1, x2, y2) -> Column:
    """A ray to +x crosses the side: its lower end belongs to it, its upper doesn't; level sides never count."""
    at = (y - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0)) + x1
    return F.coalesce((y >= F.least(y1, y2)) & (y < F.greatest(y1, y2)) & (at > x), F.lit(False))


def in_polygon(x: Column, y: Column, ring: Ring | Column) -> Column:
    """Even-odd rule with a ray to +x."""
    if isinstance(ring, Column):
        n = F.size(ring)
        sides = F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.element_at(ring, (i + 1) % n + 1).alias("b")))
        odd = F.aggregate(sides, F.lit(False), lambda s, e: s != _crossing(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
        return odd
    hits = [_crossing(x, y, *map(lit, e)).cast("int") for e in edges(ring)]
    return reduce(lambda a, b: a + b, hits, F.lit(0)) % 2 == 1


def in_polygon_left(x: Column, y: Column, ring: Ring) -> Column:
    """The second rule: a ray to -x, sides half-open below (their upper end belongs to them)."""
    hits = []
    for x1, y1, x2, y2 in edges(ring):
        if y1 == y2:
            continue
        at = lit(x1) + (y - y1) / lit(y2 - y1) * lit(x2 - x1)
        spans = ((y > y1) & (y <= y2)) | ((y > y2) & (y <= y1))
        hits.append((spans & (at < x)).cast("int"))
    return reduce(lambda a, b: a + b, hits, F.lit(0)) % 2 == 1


def polygon_position(x: Column, y: Column, ring: Ring, reach: float = 1.0) -> Column:
    """0 outside, 1 inside, 2 on the boundary: within ``reach`` of a side and inside the side's box."""
    near = F.lit(False)
    for x1, y1, x2, y2 in edges(ring):
        length = math.hypot(x2 - x1, y2 - y1)
        away = F.abs(lit(y2 - y1) * x - lit(x2 - x1) * y + lit(x2 * y1 - y2 * x1)) / lit(length)
        near = near | ((away <= reach) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return F.when(near, 2).when(in_polygon(x, y, ring), 1).otherwise(0)


def polygon_area(ring: Column) -> Column:
    """Shoelace area of a ring column, whatever its orientation."""
    n = F.size(ring)
    doubled = F.aggregate(F.transform(ring, lambda p, i: p["x"] * F.element_at(ring, (i + 1) % n + 1)["y"] - F.element_at(ring, (i + 1) % n + 1)["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v)
    return F.abs(doubled) / 2


def ring_area(ring: Ring) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for x1, y1, x2, y2 in edges(ring))) / 2


def squared_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Square of the distance from a point to a segment in the plane; a segment of no length is its point."""
    px, py, x1, y1, x2, y2 = map(lit, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length2))).otherwise(F.lit(0.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


def squared_segment_distance_3d(p: Sequence[Column], a: Sequence[float], b: Sequence[float]) -> Column:
    d = [v - u for u, v in zip(a, b)]
    length2 = sum(v * v for v in d)
    along = sum(((c - u) * v for c, u, v in zip(p, map(float, a), map(float, d))), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / lit(length2))) if length2 else F.lit(0.0)
    return sum(((c - (lit(u) + t * lit(v))) * (c - (lit(u) + t * lit(v))) for c, u, v in zip(p, a, d)), F.lit(0.0))


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Two segments intersect strictly: shared ends and touching don't count."""
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    ax, ay, bx, by, cx, cy, dx, dy = map(lit, (ax, ay, bx, by, cx, cy, dx, dy))
    return (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)


def line_intersection(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Struct x, y where two lines meet; null for parallels."""
    ax, ay, bx, by, cx, cy, dx, dy = map(lit, (ax, ay, bx, by, cx, cy, dx, dy))
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / F.nullif(det, F.lit(0.0))
    return F.when(det != 0, F.struct((ax + t * (bx - ax)).alias("x"), (ay + t * (by - ay)).alias("y")))


def barycentric(px: Column, py: Column, a, b, c) -> Column:
    """Height of the triangle with corners (x, y, z) over a point; infinite outside."""
    det = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
    u = (lit(b[1] - c[1]) * (px - c[0]) + lit(c[0] - b[0]) * (py - c[1])) / lit(det)
    v = (lit(c[1] - a[1]) * (px - c[0]) + lit(a[0] - c[0]) * (py - c[1])) / lit(det)
    w = F.lit(1.0) - u - v
    return F.when((u >= 0) & (v >= 0) & (w >= 0), u * a[2] + v * b[2] + w * c[2]).otherwise(F.lit(float("inf")))


def in_box(x: Column, y: Column, box: Sequence[float]) -> Column:
    """Closed on all sides; box is (xmin, ymin, xmax, ymax)."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def in_half_open_box(x: Column, y: Column, box: Sequence[float]) -> Column:
    return (x >= box[0]) & (x < box[2]) & (y >= box[1]) & (y < box[3])


def box_contains(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])


def boxes_intersect(a: Sequence[Column], b: Sequence[Column], touching: bool = False) -> Column:
    """Strict by default: boxes that only touch don't intersect."""
    if touching:
        return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def overlap_area(a: Sequence[Column], b: Sequence[Column]) -> Column:
    wide, high = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def box_meets_circle(box: Sequence[Column], cx: float, cy: float, radius: float) -> Column:
    dx = F.lit(cx) - F.greatest(box[0], F.least(F.lit(cx), box[2]))
    dy = F.lit(cy) - F.greatest(box[1], F.least(F.lit(cy), box[3]))
    return dx * dx + dy * dy <= radius * radius


def box_area(dx: Column, dy: Column) -> Column:
    """0 for an inverted box."""
    return F.when((dx < 0) | (dy < 0), F.lit(0.0)).otherwise(dx * dy)


def cell(v: Column, origin, size: float) -> Column:
    """Index of a cell whose centre is on the lattice: shifted by half a cell less a millionth."""
    return F.floor((v + (size / 2 - size * 1e-6) - lit(origin)) / F.lit(float(size)))


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, lit(low)), lit(high))


def parabola_height(y: Column, a: float, b: float, c: float) -> Column:
    return y * y * a + y * b + c


def parabola_low(y_from: float, y_to: float, a: float, b: float, c: float) -> float:
    """Least height of a curve z = a y² + b y + c between two places."""
    at = -b / (2 * a) if a else y_from
    return min(a * y * y + b * y + c for y in (y_from, y_to, *([at] if y_from <= at <= y_to else [])))


def curve_distance(x: Column, y: Column, z: Column, curve: dict, limited: bool = True) -> Column:
    """Distance to a curve in the plane x = x0: in the cross section at the point's y; infinite beyond its ends if limited."""
    d = F.sqrt((x - curve["x0"]) * (x - curve["x0"]) + F.pow(z - parabola_height(y, curve["a"], curve["b"], curve["c"]), F.lit(2)))
    return F.when(y.between(curve["y_min"], curve["y_max"]), d).otherwise(F.lit(float("inf"))) if limited else d


def affine(col: Column, row: Column, t: Sequence[float]) -> Column:
    """Pixel to world by six coefficients (x0, dx, rx, y0, ry, dy), as a struct."""
    return F.struct((lit(t[0]) + col * t[1] + row * t[2]).alias("x"), (lit(t[3]) + col * t[4] + row * t[5]).alias("y"))


def inverse_affine(t: Sequence[float]) -> tuple[float, ...]:
    det = t[1] * t[5] - t[2] * t[4]
    return ((t[2] * t[3] - t[0] * t[5]) / det, t[5] / det, -t[2] / det, (t[0] * t[4] - t[1] * t[3]) / det, -t[4] / det, t[1] / det)


def crown_radius(h: Column, h1: float, h2: float, r1: float, r2: float, rate: float = 0.08) -> Column:
    """Search radius by height: r1 up to h1, r2 from h2 on, a saturating exponential between."""
    a = (r2 - r1) / (1 - math.exp(-rate * (h2 - h1)))
    return F.when(h < h1, F.lit(r1)).when(h > h2, F.lit(r2)).otherwise(F.lit(a) * (1 - F.exp(F.lit(-rate) * (h - h1))) + r1)


def robust_weight(r: Column, kind: str, p: float) -> Column:
    """Weight of a residual under an M-estimator with scale (or power) p."""
    q = r / F.lit(float(p))
    return {
        "pnorm": F.lit(p) / F.pow(r, F.lit(2.0 - p)),
        "tukey": F.when(r > p, F.lit(0.0)).otherwise(F.pow(1 - q * q, F.lit(2.0))),
        "fair": 1 / (1 + q),
        "logistic": F.when(r > 0, F.tanh(q) / q).otherwise(F.lit(1.0)),
        "trimmed": F.when(r > p, F.lit(0.0)).otherwise(F.lit(1.0)),
        "welsch": F.exp(-(q * q) / 2),
    }[kind]


def projection(x: Column, y: Column, direction: tuple[float, float]) -> Column:
    """Place along a direction through the origin."""
    return x * direction[0] + y * direction[1]


def ring_bounds(ring: Column) -> list[Column]:
    """x1, y1, x2, y2 of an array of places."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")]


def octree_key(i: Column, j: Column, k: Column, bits: int) -> Column:
    """One number of three cell indices from 0 on, their bits in turns."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for d, c in enumerate((i, j, k)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(1), 3 * b + d))
    return out


def octree_box(key: Column, size: float, bits: int) -> list[Column]:
    """x1, y1, z1, x2, y2, z2 of a key's cell."""
    at = []
    for d in range(3):
        c = F.lit(0).cast("long")
        for b in range(bits):
            c = c.bitwiseOR(F.shiftleft(F.shiftright(key, 3 * b + d).bitwiseAND(1), b))
        at.append(c * float(size))
    return [c.alias(f"{n}1") for c, n in zip(at, "xyz")] + [(c + float(size)).alias(f"{n}2") for c, n in zip(at, "xyz")]


def triangle_normal(a, b, c) -> list[Column]:
    """Unit normal of a triangle, by the right-hand rule; nulls for one without area."""
    u, v = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.nullif(F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]), F.lit(0.0))
    return [x / size for x in n]


def share_above(h1: Column, h2: Column, h3: Column) -> Column:
    """Share of a triangle's area on the positive side of a plane, by its corners' heights over it."""
    tip = lambda a, b, c: a / (a - b) * a / (a - c)
    up = [h > 0 for h in (h1, h2, h3)]
    out = F.when(up[0] & up[1] & up[2], 1.0).when(~up[0] & ~up[1] & ~up[2], 0.0)
    for (a, b, c), (i, j, k) in zip(((h1, h2, h3), (h2, h1, h3), (h3, h1, h2)), ((0, 1, 2), (1, 0, 2), (2, 0, 1))):
        out = out.when(up[i] & ~up[j] & ~up[k], tip(a, b, c)).when(~up[i] & up[j] & up[k], 1 - tip(a, b, c))
    return out
