"""Delaunay triangulation of the points of one tile, by insertion, with exact decisions.

Of cocircular points the one that comes first by (x, y) counts as infinitely little lifted, so each set of points has one
triangulation, and every subset of the plane agrees about it. Decisions that floating point can't make sure are made in integers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

#: Relative errors that the two determinants may have.
_LINE, _CIRCLE = 4.0e-16, 1.2e-15
#: Half a unit of the last digit, of double and of long numbers.
_HALF, _LONG = 2.0**-53, np.finfo(np.longdouble).eps / 2
OUTSIDE = -1


class Plane:
    """Points with x, y, all at different places, and the signs of their determinants."""

    def __init__(self, x: Sequence[float], y: Sequence[float]):
        self.x, self.y, self._whole = list(map(float, x)), list(map(float, y)), None
        order = sorted(range(len(self.x)), key=lambda i: (self.x[i], self.y[i]))
        self.rank = [0] * len(order)
        for k, i in enumerate(order):
            self.rank[i] = k

    def whole(self):
        """The coordinates as integers, all by one power of two."""
        if self._whole is None:
            ratios = [v.as_integer_ratio() for v in self.x + self.y]
            scale = max((d for _, d in ratios), default=1)
            numbers = [n * (scale // d) for n, d in ratios]
            self._whole = numbers[: len(self.x)], numbers[len(self.x) :]
        return self._whole

    def turn(self, a: int, b: int, c: int) -> int:
        """1 if c lies left of the line from a to b, -1 if right, 0 on it."""
        x, y = self.x, self.y
        p, q = (x[b] - x[a]) * (y[c] - y[a]), (y[b] - y[a]) * (x[c] - x[a])
        d = p - q
        if abs(d) > _LINE * (abs(p) + abs(q)):
            return 1 if d > 0 else -1
        x, y = self.whole()
        d = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
        return (d > 0) - (d < 0)

    def in_circle(self, a: int, b: int, c: int, d: int) -> bool:
        """Whether d lies in the circle of the triangle a, b, c, which turns left."""
        sign = self._circle(self.x, self.y, a, b, c, d, _CIRCLE)
        if sign is None:
            sign = self._circle(*self.whole(), a, b, c, d, 0)
        if sign:
            return sign > 0
        for p in sorted((a, b, c, d), key=self.rank.__getitem__):  # the first is lifted most
            if p == d:
                return False
            share = self.turn(*((d, b, c) if p == a else (a, d, c) if p == b else (a, b, d)))
            if share:
                return share > 0
        return False

    @staticmethod
    def _circle(x, y, a, b, c, d, error):
        ax, ay, bx, by, cx, cy = x[a] - x[d], y[a] - y[d], x[b] - x[d], y[b] - y[d], x[c] - x[d], y[c] - y[d]
        al, bl, cl = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        bc1, bc2, ca1, ca2, ab1, ab2 = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
        det = al * (bc1 - bc2) + bl * (ca1 - ca2) + cl * (ab1 - ab2)
        if error and abs(det) <= error * (al * (abs(bc1) + abs(bc2)) + bl * (abs(ca1) + abs(ca2)) + cl * (abs(ab1) + abs(ab2))):
            return None
        return (det > 0) - (det < 0)


def triangles(x: Sequence[float], y: Sequence[float]) -> list[tuple[int, int, int]]:
    """All triangles (a, b, c), each turning left; those with OUTSIDE last stand beyond the edges of the hull. Points lie at different places;
    fewer than three points, or points on one line, give none."""
    n, plane = len(x), Plane(x, y)
    order = _along_cells(plane.x, plane.y)
    first = next(((order[0], order[1], i) for i in order[2:] if plane.turn(order[0], order[1], i)), None) if n > 2 else None
    if first is None:
        return []
    a, b, c = first if plane.turn(*first) > 0 else (first[1], first[0], first[2])
    corners: list = [[a, b, c], [b, a, OUTSIDE], [c, b, OUTSIDE], [a, c, OUTSIDE]]
    # beside[t][k]: the triangle over the edge from corner k to corner k + 1
    beside: list = [[1, 2, 3], [0, 3, 2], [0, 1, 3], [0, 2, 1]]
    free: list[int] = []
    last, turn, x_, y_ = 0, plane.turn, plane.x, plane.y

    def conflicts(t: int, p: int) -> bool:
        u, v, w = corners[t]
        if w != OUTSIDE:
            return plane.in_circle(u, v, w, p)
        side = turn(u, v, p)
        return side > 0 or not side and (min(x_[u], x_[v]), min(y_[u], y_[v])) <= (x_[p], y_[p]) and x_[p] <= max(x_[u], x_[v]) and min(y_[u], y_[v]) <= y_[p] <= max(y_[u], y_[v])

    for p in order:
        if p in first:
            continue
        t = last if corners[last][2] != OUTSIDE else beside[last][0]
        while corners[t][2] != OUTSIDE:
            u, v, w = corners[t]
            if turn(u, v, p) < 0:
                t = beside[t][0]
            elif turn(v, w, p) < 0:
                t = beside[t][1]
            elif turn(w, u, p) < 0:
                t = beside[t][2]
            else:
                break
        cavity, stack, edges = {t}, [t], []
        while stack:
            t = stack.pop()
            for k in range(3):
                o = beside[t][k]
                if o in cavity:
                    continue
                if conflicts(o, p):
                    cavity.add(o)
                    stack.append(o)
                else:
                    edges.append((corners[t][k], corners[t][(k + 1) % 3], o))
        free += cavity
        starts, ends = {}, {}
        for u, v, o in edges:
            if free:
                t = free.pop()
            else:
                t = len(corners)
                corners.append(None)
                beside.append(None)
            k = next(k for k in range(3) if corners[o][k] == v and corners[o][(k + 1) % 3] == u)
            beside[o][k] = t
            # OUTSIDE always stands last
            corners[t], shift = ([u, v, p], 0) if OUTSIDE not in (u, v) else ([v, p, u], 2) if u == OUTSIDE else ([p, u, v], 1)
            beside[t] = [0, 0, 0]
            beside[t][shift] = o
            starts[u], ends[v] = (t, (shift + 2) % 3), (t, (shift + 1) % 3)
        for v, (t, k) in ends.items():
            o, l = starts[v]
            beside[t][k], beside[o][l] = o, t
        last = t
    unused = set(free)
    return [tuple(c) for t, c in enumerate(corners) if t not in unused]


def _along_cells(x: list[float], y: list[float]) -> list[int]:
    """The points in an order in which neighbours mostly follow each other: row by row of cells, to and fro."""
    n = len(x)
    if n < 3:
        return list(range(n))
    side = max(1, int(math.sqrt(n / 2)))
    low, span = (min(x), min(y)), (max(x) - min(x) or 1.0, max(y) - min(y) or 1.0)

    def key(i: int):
        row = min(side - 1, int((y[i] - low[1]) / span[1] * side))
        return row, x[i] if row % 2 == 0 else -x[i], y[i]

    return sorted(range(n), key=key)


def many(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The triangles of ``triangles`` for many sets of points at once: group numbers the set of each point, and its points follow one another. Rows of
    corners, OUTSIDE last; sets of fewer than three points or with all on one line have none.

    Each set begins with a fan over its hull. Then every triangle takes one of the points in it, and edges are flipped until they are right, in
    rounds of array operations over all sets; which points come first is left to chance, but the triangles are the same."""
    return _Mesh(group, x, y).run()


class _Mesh:
    """Half edges: 3 t + k goes from corner k of triangle t to the next one; ``twin`` is the other half. The corner n is outside."""

    def __init__(self, group: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.n, self.group = len(x), np.asarray(group)
        self.x, self.y = (np.append(np.asarray(v, dtype=float), 0.0) for v in (x, y))
        self.lx, self.ly = self.x.astype(np.longdouble), self.y.astype(np.longdouble)
        self._whole = None
        self.rank = np.empty(self.n + 1, dtype=np.int64)
        self.rank[np.lexsort((self.y[:-1], self.x[:-1]))] = np.arange(self.n)

    def whole(self):
        """The coordinates as integers, all by one power of two."""
        if self._whole is None:
            part, power = np.frexp(np.concatenate([self.x, self.y]))
            digits = np.ldexp(part, 53).astype(np.int64).astype(object)
            power = np.where(part == 0, power.max(), power)
            numbers = digits << (power - power.min()).astype(object)
            self._whole = numbers[: self.n + 1], numbers[self.n + 1 :]
        return self._whole

    def turn(self, a, b, c) -> np.ndarray:
        """1 where c lies left of the line from a to b, -1 right, 0 on it."""
        out, open_ = np.zeros(len(a), dtype=np.int8), None
        for x, y, error in ((self.x, self.y, _LINE), (self.lx, self.ly, _LINE / _HALF * _LONG)):
            ax, ay = x[a], y[a]
            ux, uy, vx, vy = x[b] - ax, y[b] - ay, x[c] - ax, y[c] - ay
            p, q = ux * vy, uy * vx
            d = p - q
            sure = np.abs(d) > error * (np.abs(p) + np.abs(q))
            sign = np.where(sure, np.sign(d), 0).astype(np.int8)
            unsure = np.flatnonzero(~sure & ~(((ux == 0) | (vy == 0)) & ((uy == 0) | (vx == 0))))
            if open_ is None:
                out, open_ = sign, unsure
            else:
                out[open_] = sign
                open_ = open_[unsure]
            if not len(unsure):
                return out
            a, b, c = a[unsure], b[unsure], c[unsure]
        x, y = self.whole()
        d = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
        out[open_] = (d > 0).astype(np.int8) - (d < 0).astype(np.int8)
        return out

    def circle(self, a, b, c, d) -> np.ndarray:
        """The sign of the determinant that is above 0 where d lies in the circle of a, b, c."""
        out, open_ = None, None
        for x, y, error in ((self.x, self.y, _CIRCLE), (self.lx, self.ly, _CIRCLE / _HALF * _LONG)):
            det, size = _circles(x, y, a, b, c, d)
            sure = np.abs(det) > error * size
            sign, unsure = np.where(sure, np.sign(det), 0).astype(np.int8), np.flatnonzero(~sure)
            if open_ is None:
                out, open_ = sign, unsure
            else:
                out[open_] = sign
                open_ = open_[unsure]
            if not len(unsure):
                return out
            a, b, c, d = a[unsure], b[unsure], c[unsure], d[unsure]
        det, _ = _circles(*self.whole(), a, b, c, d)
        out[open_] = (det > 0).astype(np.int8) - (det < 0).astype(np.int8)
        return out

    def hulls(self) -> list[list[int]]:
        """The strict hull of each set, turning left; none for points on one line."""
        starts = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]]) if self.n else np.zeros(0, dtype=np.int64)
        own = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, self.n]))
        x, y = self.x[:-1], self.y[:-1]
        inside = np.ones(self.n, dtype=bool)
        corners = []
        for u, v in ((1, 1), (-1, 1), (-1, -1), (1, -1)):  # the least by these sums lie at the corners, turning left
            s = u * x + v * y
            at = np.flatnonzero(s == np.minimum.reduceat(s, starts)[own]) if self.n else starts
            first = np.zeros(len(starts), dtype=np.int64)
            first[own[at]] = at
            corners.append(first[own])
        for p, q in zip(corners, corners[1:] + corners[:1]):
            a, b = (x[q] - x[p]) * (y - y[p]), (y[q] - y[p]) * (x - x[p])
            inside &= a - b > _LINE * (np.abs(a) + np.abs(b))
        rest = np.flatnonzero(~inside)
        rest = rest[np.lexsort((self.rank[rest], own[rest]))]
        ends = np.searchsorted(own[rest], np.arange(len(starts) + 1))
        xs, ys = self.x.tolist(), self.y.tolist()

        def left(a: int, b: int, c: int) -> bool:
            p, q = (xs[b] - xs[a]) * (ys[c] - ys[a]), (ys[b] - ys[a]) * (xs[c] - xs[a])
            if abs(p - q) > _LINE * (abs(p) + abs(q)):
                return p > q
            return bool(self.turn(*(np.array([k]) for k in (a, b, c)))[0] > 0) if ys[a] != ys[b] or ys[a] != ys[c] else False

        out = []
        for i in range(len(starts)):
            points, ring = rest[ends[i] : ends[i + 1]].tolist(), []
            for way in (points, points[::-1]):
                chain: list[int] = []
                for p in way:
                    while len(chain) > 1 and not left(chain[-2], chain[-1], p):
                        chain.pop()
                    chain.append(p)
                ring += chain[:-1]
            out.append(ring if len(ring) > 2 else [])
        self.own = own
        return out

    def run(self) -> np.ndarray:
        hulls = self.hulls()
        n, out = self.n, self.n
        used = sum(2 * len(h) - 2 for h in hulls if h)  # triangles of the fans and beyond the hulls
        most = max(2 * n, used) + 1
        self.corner, self.twin = np.full(3 * most, out, dtype=np.int64), np.full(3 * most, -1, dtype=np.int64)
        self.moved, self.stamp, self.flipped = np.arange(3 * most), np.full(3 * most, -1, dtype=np.int64), np.full(most, -1, dtype=np.int64)
        corner, twin = self.corner, self.twin
        ring = np.array([v for h in hulls for v in h], dtype=np.int64)
        size = np.array([len(h) for h in hulls], dtype=np.int64)
        begin = np.r_[0, np.cumsum(size)]  # of a set's hull in ring
        base = np.r_[0, np.cumsum(np.maximum(2 * size - 2, 0))]  # of its triangles: size - 2 of the fan, then size beyond the edges
        for i in np.flatnonzero(size):
            h, m, b = ring[begin[i] : begin[i + 1]], int(size[i]), int(base[i])
            k = np.arange(m - 2)
            t, g = 3 * (b + k), 3 * (b + m - 2 + np.arange(m))
            corner[t], corner[t + 1], corner[t + 2] = h[0], h[1:-1], h[2:]
            twin[t[1:]], twin[t[:-1] + 2] = t[:-1] + 2, t[1:]
            # beyond edge j, from h[j] to the next one
            corner[g], corner[g + 1] = np.roll(h, -1), h
            inner = np.r_[t[0], t + 1, t[-1] + 2]
            twin[inner], twin[g] = g, inner
            twin[g + 1], twin[np.roll(g, 1) + 2] = np.roll(g, 1) + 2, g + 1
        on = np.zeros(n, dtype=bool)
        on[ring] = True
        rest = np.flatnonzero(~on & (size[self.own] > 0)) if n else np.zeros(0, dtype=np.int64)
        rest = np.random.default_rng(7).permutation(rest)
        # the fan's triangle of a point, by halving
        own = self.own[rest]
        first, low, high = begin[own], np.ones(len(rest), dtype=np.int64), size[own] - 1
        while (high - low > 1).any():
            middle = (low + high) // 2
            beyond = self.turn(ring[first], ring[first + middle], rest) >= 0
            low, high = np.where(beyond, middle, low), np.where(beyond, np.maximum(high, middle + 1), middle)
        self.at = np.full(n + 1, -1, dtype=np.int64)
        self.at[rest] = base[own] + low - 1
        self.legal(3 * np.flatnonzero(corner.reshape(-1, 3)[:used, 2] != out), rest)
        while len(rest):
            rest, used = self.insert(rest, used)
        found = corner[: 3 * used].reshape(-1, 3)
        away = np.argmax(found == out, axis=1)
        shift = np.where((found == out).any(axis=1), (away + 1) % 3, 0)
        found = np.take_along_axis(found, (shift[:, None] + np.arange(3)) % 3, axis=1)
        return np.where(found == out, OUTSIDE, found)

    def insert(self, rest: np.ndarray, used: int) -> tuple[np.ndarray, int]:
        """One point of each triangle that has some, and the edges around; what is left, and the number of triangles."""
        corner, twin, at = self.corner, self.twin, self.at
        self.flipped[at[rest[::-1]]] = rest[::-1]
        p = rest[self.flipped[at[rest]] == rest]
        self.flipped[at[rest]] = -1
        t = at[p]
        a, b, c = (corner[3 * t + k] for k in range(3))
        flat = np.stack([self.turn(a, b, p), self.turn(b, c, p), self.turn(c, a, p)]) == 0
        # of two points on one edge, from both sides, one waits
        edge = np.where(flat.any(axis=0), 3 * t + np.argmax(flat, axis=0), -1)
        there = np.flatnonzero(edge >= 0)
        self.stamp[edge[there]] = 1
        wait = there[(self.stamp[twin[edge[there]]] == 1) & (edge[there] > twin[edge[there]])]
        self.stamp[edge[there]] = -1
        if len(wait):
            go = np.ones(len(p), dtype=bool)
            go[wait] = False
            p, t, a, b, c, flat = p[go], t[go], a[go], b[go], c[go], flat[:, go]
        m = len(p)
        t1 = used + 2 * np.arange(m)
        t2 = t1 + 1
        outer = np.stack([3 * t, 3 * t + 1, 3 * t + 2]).ravel()
        new = np.concatenate([3 * t, 3 * t1, 3 * t2])
        self.relink(outer, new)
        for s, u, v in ((t, a, b), (t1, b, c), (t2, c, a)):
            corner[3 * s], corner[3 * s + 1], corner[3 * s + 2] = u, v, p
        for s, o in ((t, t1), (t1, t2), (t2, t)):
            twin[3 * s + 1], twin[3 * o + 2] = 3 * o + 2, 3 * s + 1
        at[p] = -1
        rest = rest[at[rest] >= 0]
        self.flipped[t] = np.arange(m)
        k = self.flipped[at[rest]]
        self.flipped[t] = -1
        q, k = rest[k >= 0], k[k >= 0]
        sa, sb, sc = (self.turn(p[k], v[k], q) for v in (a, b, c))
        in0, in1 = (sa >= 0) & (sb <= 0) & ~flat[0][k], (sb >= 0) & (sc <= 0) & ~flat[1][k]
        at[q] = np.where(in0, t[k], np.where(in1, t1[k], t2[k]))
        self.legal(new, rest)
        return rest, used + 2 * m

    def relink(self, old: np.ndarray, new: np.ndarray) -> None:
        """Half edges at new numbers, tied to their twins, which may move as well."""
        self.moved[old] = new
        other = self.moved[self.twin[old]]
        self.moved[old] = old
        self.twin[new], self.twin[other] = other, new

    def legal(self, h: np.ndarray, rest: np.ndarray) -> None:
        """Flips edges, and then those around, until none of them is wrong. Flips of a round have no triangle in common."""
        corner, twin, out = self.corner, self.twin, self.n
        after = lambda e: e + 1 - 3 * (e % 3 == 2)
        before = lambda e: e - 1 + 3 * (e % 3 == 0)
        while len(h):
            h = np.minimum(h, twin[h])
            self.stamp[h] = np.arange(len(h))
            h = h[self.stamp[h] == np.arange(len(h))]
            self.stamp[h] = -1
            g = twin[h]
            a, b, c, d = corner[h], corner[g], corner[before(h)], corner[before(g)]
            wrong, beyond = np.zeros(len(h), dtype=bool), (c == out) | (d == out)
            plain = np.flatnonzero(~beyond & (a != out) & (b != out))
            sign = self.circle(a[plain], b[plain], c[plain], d[plain])
            # of cocircular points the first one is lifted most, so it has no edge between them
            wrong[plain] = (sign > 0) | (sign == 0) & (np.minimum(self.rank[a[plain]], self.rank[b[plain]]) < np.minimum(self.rank[c[plain]], self.rank[d[plain]]))
            hull = np.flatnonzero(beyond & (a != out) & (b != out))
            wrong[hull] = self.turn(a[hull], b[hull], np.where(c[hull] == out, d[hull], c[hull])) == 0
            h, g, a, b, c, d = (v[wrong] for v in (h, g, a, b, c, d))
            if not len(h):
                return
            t, s, number = h // 3, g // 3, np.arange(len(h))
            self.flipped[np.stack([t, s], axis=1).ravel()] = np.repeat(number, 2)
            now = (self.flipped[t] == number) & (self.flipped[s] == number)
            self.flipped[t] = self.flipped[s] = -1
            later = h[~now]
            h, g, a, b, c, d, t, s = (v[now] for v in (h, g, a, b, c, d, t, s))
            old = np.concatenate([after(g), before(h), before(g), after(h)])
            new = np.concatenate([3 * t, 3 * t + 2, 3 * s, 3 * s + 1])
            # edges that wait may belong to triangles that don't turn now, but their halves may be numbered anew
            self.moved[old] = new
            later = self.moved[later]
            self.moved[old] = old
            self.relink(old, new)
            for k, v in enumerate((a, d, c)):
                corner[3 * t + k] = v
            for k, v in enumerate((d, b, c)):
                corner[3 * s + k] = v
            twin[3 * t + 1], twin[3 * s + 2] = 3 * s + 2, 3 * t + 1
            if len(rest):
                number = np.arange(len(t))
                self.flipped[t] = self.flipped[s] = number
                k = self.flipped[self.at[rest]]
                self.flipped[t] = self.flipped[s] = -1
                q, k = rest[k >= 0], k[k >= 0]
                self.at[q] = np.where(self.turn(d[k], c[k], q) >= 0, t[k], s[k])
            h = np.concatenate([new, later])


def _circles(x, y, a, b, c, d):
    """The determinants of circles, and the sums that bound their errors."""
    dx, dy = x[d], y[d]
    ax, ay, bx, by, cx, cy = x[a] - dx, y[a] - dy, x[b] - dx, y[b] - dy, x[c] - dx, y[c] - dy
    al, bl, cl = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    bc1, bc2, ca1, ca2, ab1, ab2 = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
    det = al * (bc1 - bc2) + bl * (ca1 - ca2) + cl * (ab1 - ab2)
    return det, al * (abs(bc1) + abs(bc2)) + bl * (abs(ca1) + abs(ca2)) + cl * (abs(ab1) + abs(ab2))
