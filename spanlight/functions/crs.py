"""Map projections as column expressions: UTM and transverse Mercator, Lambert conformal conic, Albers equal area, geocentric. Angles in degrees."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


WGS84 = Ellipsoid(6378137.0, 1 / 298.257223563)
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def central_meridian(zone: Column) -> Column:
    return (zone * 6 - 183).cast("double")


def meridian_arc(lat: Column, e: Ellipsoid) -> Column:
    """Length of the meridian from the equator; lat in radians."""
    e2 = e.e2
    c = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)
    return e.a * (c[0] * lat - c[1] * F.sin(2 * lat) + c[2] * F.sin(4 * lat) - c[3] * F.sin(6 * lat))


def to_transverse_mercator(lon: Column, lat: Column, lon0: Column, scale: float = 1.0, east: float = 0.0, north: float = 0.0, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    """Easting and northing, by the series to the sixth power."""
    p, e2 = F.radians(lat), e.e2
    ep2 = e2 / (1 - e2)
    n = e.a / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    t, c = F.tan(p) * F.tan(p), ep2 * F.cos(p) * F.cos(p)
    a = F.cos(p) * F.radians(lon - lon0)
    x = n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a**5 / 120)
    y = meridian_arc(p, e) + n * F.tan(p) * (a**2 / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a**6 / 720)
    return scale * x + east, scale * y + north


def from_transverse_mercator(x: Column, y: Column, lon0: Column, scale: float = 1.0, east: float = 0.0, north: float = 0.0, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    e2 = e.e2
    ep2, e1 = e2 / (1 - e2), (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = (y - north) / scale / (e.a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
    s = 1 - e2 * F.sin(p) * F.sin(p)
    n, r = e.a / F.sqrt(s), e.a * (1 - e2) / (s * F.sqrt(s))
    t, c = F.tan(p) * F.tan(p), ep2 * F.cos(p) * F.cos(p)
    d = (x - east) / scale / n
    lat = p - n * F.tan(p) / r * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * d**6 / 720)
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * d**5 / 120) / F.cos(p)
    return lon0 + F.degrees(lon), F.degrees(lat)


def to_utm(lon: Column, lat: Column, zone: Column | None = None) -> tuple[Column, Column, Column]:
    """zone, easting, northing; southern latitudes count from ten million."""
    zone = utm_zone(lon) if zone is None else zone
    x, y = to_transverse_mercator(lon, lat, central_meridian(zone), UTM_SCALE, UTM_EAST)
    return zone, x, F.when(lat < 0, y + UTM_SOUTH).otherwise(y)


def from_utm(zone: Column, x: Column, y: Column, south: Column) -> tuple[Column, Column]:
    return from_transverse_mercator(x, F.when(south, y - UTM_SOUTH).otherwise(y), central_meridian(zone), UTM_SCALE, UTM_EAST)


def to_geocentric(lon: Column, lat: Column, h: Column, e: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    n = e.a / F.sqrt(1 - e.e2 * F.sin(p) * F.sin(p))
    return (n + h) * F.cos(p) * F.cos(q), (n + h) * F.cos(p) * F.sin(q), (n * (1 - e.e2) + h) * F.sin(p)


def from_geocentric(x: Column, y: Column, z: Column, e: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    """Longitude, latitude and height, by the closed form with the parametric latitude."""
    b = e.a * (1 - e.f)
    r, ep2 = F.sqrt(x * x + y * y), e.e2 / (1 - e.e2)
    t = F.atan2(z * e.a, r * b)
    lat = F.atan2(z + ep2 * b * F.pow(F.sin(t), F.lit(3)), r - e.e2 * e.a * F.pow(F.cos(t), F.lit(3)))
    n = e.a / F.sqrt(1 - e.e2 * F.sin(lat) * F.sin(lat))
    return F.degrees(F.atan2(y, x)), F.degrees(lat), r / F.cos(lat) - n


def from_conformal(c: Column, e: Ellipsoid) -> Column:
    """Latitude in degrees of a conformal latitude in radians, by the series to the eighth power of the eccentricity."""
    e2 = e.e2
    p = c + F.sin(2 * c) * (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360) + F.sin(4 * c) * (7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520) + F.sin(6 * c) * (7 * e2**3 / 120 + 81 * e2**4 / 1120) + F.sin(8 * c) * (4279 * e2**4 / 161280)
    return F.degrees(p)


class LambertConformalConic:
    """With two standard parallels; the constants are computed once on the driver."""

    def __init__(self, lat1: float, lat2: float, lat0: float, lon0: float, east: float = 0.0, north: float = 0.0, e: Ellipsoid = WGS84):
        self.e, self.lon0, self.east, self.north = e, lon0, east, north
        k = math.sqrt(e.e2)
        m = lambda p: math.cos(p) / math.sqrt(1 - e.e2 * math.sin(p) ** 2)
        t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - k * math.sin(p)) / (1 + k * math.sin(p))) ** (k / 2)
        p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
        self.n = math.sin(p1) if lat1 == lat2 else (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
        self.f = m(p1) / (self.n * t(p1) ** self.n)
        self.rho0 = e.a * self.f * t(p0) ** self.n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        p, k = F.radians(lat), math.sqrt(self.e.e2)
        t = F.tan(math.pi / 4 - p / 2) / F.pow((1 - k * F.sin(p)) / (1 + k * F.sin(p)), F.lit(k / 2))
        rho, a = self.e.a * self.f * F.pow(t, F.lit(self.n)), self.n * F.radians(lon - self.lon0)
        return rho * F.sin(a) + self.east, self.rho0 - rho * F.cos(a) + self.north

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        dx, dy, sign = x - self.east, self.rho0 - (y - self.north), math.copysign(1, self.n)
        rho = sign * F.sqrt(dx * dx + dy * dy)
        t = F.pow(rho / (self.e.a * self.f), F.lit(1 / self.n))
        return F.degrees(F.atan2(sign * dx, sign * dy) / self.n) + self.lon0, from_conformal(math.pi / 2 - 2 * F.atan(t), self.e)


class AlbersEqualArea:
    def __init__(self, lat1: float, lat2: float, lat0: float, lon0: float, east: float = 0.0, north: float = 0.0, e: Ellipsoid = WGS84):
        self.e, self.lon0, self.east, self.north, self.k = e, lon0, east, north, math.sqrt(e.e2)
        p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
        m = lambda p: math.cos(p) / math.sqrt(1 - e.e2 * math.sin(p) ** 2)
        q = lambda p: (1 - e.e2) * (math.sin(p) / (1 - e.e2 * math.sin(p) ** 2) - math.log((1 - self.k * math.sin(p)) / (1 + self.k * math.sin(p))) / (2 * self.k))
        self.n = math.sin(p1) if lat1 == lat2 else (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
        self.c = m(p1) ** 2 + self.n * q(p1)
        self.rho0 = e.a * math.sqrt(self.c - self.n * q(p0)) / self.n

    def _q(self, p: Column) -> Column:
        s = F.sin(p)
        return (1 - self.e.e2) * (s / (1 - self.e.e2 * s * s) - F.log((1 - self.k * s) / (1 + self.k * s)) / (2 * self.k))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        rho = self.e.a * F.sqrt(self.c - self.n * self._q(F.radians(lat))) / self.n
        a = self.n * F.radians(lon - self.lon0)
        return rho * F.sin(a) + self.east, self.rho0 - rho * F.cos(a) + self.north

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        dx, dy, e2 = x - self.east, self.rho0 - (y - self.north), self.e.e2
        rho2 = dx * dx + dy * dy
        q = (self.c - rho2 * self.n * self.n / self.e.a**2) / self.n

        def better(p: Column) -> Column:
            s = F.sin(p)
            w = 1 - e2 * s * s
            return p + w * w / (2 * F.cos(p)) * (q / (1 - e2) - s / w + F.log((1 - self.k * s) / (1 + self.k * s)) / (2 * self.k))

        p = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.asin(q / 2), lambda p, _: better(p))
        sign = math.copysign(1, self.n)
        return F.degrees(F.atan2(sign * dx, sign * dy) / self.n) + self.lon0, F.degrees(p)


class TransverseMercator:
    def __init__(self, lat0: float, lon0: float, scale: float, east: float, north: float, e: Ellipsoid = WGS84):
        self.lon0, self.scale, self.east, self.e = lon0, scale, east, e
        p, e2 = math.radians(lat0), e.e2
        c = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)
        self.north = north - scale * e.a * (c[0] * p - c[1] * math.sin(2 * p) + c[2] * math.sin(4 * p) - c[3] * math.sin(6 * p))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return to_transverse_mercator(lon, lat, F.lit(self.lon0), self.scale, self.east, self.north, self.e)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return from_transverse_mercator(x, y, F.lit(self.lon0), self.scale, self.east, self.north, self.e)


class ObliqueStereographic:
    """Double stereographic: the ellipsoid onto a sphere, the sphere onto the plane."""

    def __init__(self, lat0: float, lon0: float, scale: float, east: float, north: float, e: Ellipsoid = WGS84):
        self.e, self.lon0, self.east, self.north, self.k = e, lon0, east, north, math.sqrt(e.e2)
        p, s = math.radians(lat0), math.sin(math.radians(lat0))
        w = 1 - e.e2 * s * s
        self.n = math.sqrt(1 + e.e2 * math.cos(p) ** 4 / (1 - e.e2))
        w1 = ((1 + s) / (1 - s) * ((1 - self.k * s) / (1 + self.k * s)) ** self.k) ** self.n
        sin_chi = (w1 - 1) / (w1 + 1)
        self.c = (self.n + s) * (1 - sin_chi) / ((self.n - s) * (1 + sin_chi))
        self.chi = math.asin((self.c * w1 - 1) / (self.c * w1 + 1))
        self.size = 2 * scale * math.sqrt(e.a * (1 - e.e2) / w**1.5 * e.a / math.sqrt(w))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        s = F.sin(F.radians(lat))
        w = self.c * F.pow((1 + s) / (1 - s) * F.pow((1 - self.k * s) / (1 + self.k * s), F.lit(self.k)), F.lit(self.n))
        chi, a = F.asin((w - 1) / (w + 1)), self.n * F.radians(lon - self.lon0)
        b = 1 + F.sin(chi) * math.sin(self.chi) + F.cos(chi) * math.cos(self.chi) * F.cos(a)
        return self.east + self.size * F.cos(chi) * F.sin(a) / b, self.north + self.size * (F.sin(chi) * math.cos(self.chi) - F.cos(chi) * math.sin(self.chi) * F.cos(a)) / b

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        dx, dy = x - self.east, y - self.north
        g = self.size * math.tan(math.pi / 4 - self.chi / 2)
        h = 2 * self.size * math.tan(self.chi) + g
        i = F.atan(dx / (h + dy))
        j = F.atan(dx / (g - dy)) - i
        chi = self.chi + 2 * F.atan((dy - dx * F.tan(j / 2)) / self.size)
        psi = F.log((1 + F.sin(chi)) / (self.c * (1 - F.sin(chi)))) / 2 / self.n
        return F.degrees(j + 2 * i) / self.n + self.lon0, from_conformal(2 * F.atan(F.exp(psi)) - math.pi / 2, self.e)


class HotineObliqueMercator:
    """Variant B: false coordinates at the projection's centre."""

    def __init__(self, lat0: float, lon0: float, azimuth: float, skew: float, scale: float, east: float, north: float, e: Ellipsoid = WGS84):
        self.e, self.east, self.north, self.k, self.skew = e, east, north, math.sqrt(e.e2), math.radians(skew)
        p, s, az = math.radians(lat0), math.sin(math.radians(lat0)), math.radians(azimuth)
        self.b = math.sqrt(1 + e.e2 * math.cos(p) ** 4 / (1 - e.e2))
        self.a = e.a * self.b * scale * math.sqrt(1 - e.e2) / (1 - e.e2 * s * s)
        t0 = math.tan(math.pi / 4 - p / 2) / ((1 - self.k * s) / (1 + self.k * s)) ** (self.k / 2)
        d = max(1.0, self.b * math.sqrt(1 - e.e2) / (math.cos(p) * math.sqrt(1 - e.e2 * s * s)))
        f = d + math.copysign(math.sqrt(d * d - 1), lat0)
        self.h = f * t0**self.b
        self.gamma = math.asin(math.sin(az) / d)
        self.lon0 = lon0 - math.degrees(math.asin((f - 1 / f) / 2 * math.tan(self.gamma)) / self.b)
        self.u0 = math.copysign(self.a / self.b * math.atan(math.sqrt(d * d - 1) / math.cos(az)), lat0)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        p, across = F.radians(lat), self.b * F.radians(lon - self.lon0)
        t = F.tan(math.pi / 4 - p / 2) / F.pow((1 - self.k * F.sin(p)) / (1 + self.k * F.sin(p)), F.lit(self.k / 2))
        q = self.h / F.pow(t, F.lit(self.b))
        s, v = (q - 1 / q) / 2, F.sin(across)
        inner = (s * math.sin(self.gamma) - v * math.cos(self.gamma)) / ((q + 1 / q) / 2)
        along = self.a / self.b * F.atan2(s * math.cos(self.gamma) + v * math.sin(self.gamma), F.cos(across)) - self.u0
        side = self.a * F.log((1 - inner) / (1 + inner)) / (2 * self.b)
        return side * math.cos(self.skew) + along * math.sin(self.skew) + self.east, along * math.cos(self.skew) - side * math.sin(self.skew) + self.north

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        dx, dy = x - self.east, y - self.north
        side, along = dx * math.cos(self.skew) - dy * math.sin(self.skew), dy * math.cos(self.skew) + dx * math.sin(self.skew) + self.u0
        q = F.exp(-self.b * side / self.a)
        s, v, turn = (q - 1 / q) / 2, F.sin(self.b * along / self.a), F.cos(self.b * along / self.a)
        inner = (v * math.cos(self.gamma) + s * math.sin(self.gamma)) / ((q + 1 / q) / 2)
        t = F.pow(self.h / F.sqrt((1 + inner) / (1 - inner)), F.lit(1 / self.b))
        return self.lon0 - F.degrees(F.atan2(s * math.cos(self.gamma) - v * math.sin(self.gamma), turn)) / self.b, from_conformal(math.pi / 2 - 2 * F.atan(t), self.e)


class Geographic:
    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    inverse = forward


# Ellipsoids, and the parameters of reference systems by their EPSG codes.
GRS80, CGCS2000 = Ellipsoid(6378137.0, 1 / 298.257222101), Ellipsoid(6378137.0, 1 / 298.257222101)
BESSEL, AIRY, CLARKE_1866, EVEREST = Ellipsoid(6377397.155, 1 / 299.1528128), Ellipsoid(6377563.396, 1 / 299.3249646), Ellipsoid(6378206.4, 1 / 294.978698214), Ellipsoid(6377298.556, 1 / 300.8017)
SYSTEMS = {
    4326: lambda: Geographic(),
    2154: lambda: LambertConformalConic(49.0, 44.0, 46.5, 3.0, 700_000.0, 6_600_000.0, GRS80),
    3005: lambda: AlbersEqualArea(50.0, 58.5, 45.0, -126.0, 1_000_000.0, 0.0, GRS80),
    5070: lambda: AlbersEqualArea(29.5, 45.5, 23.0, -96.0, 0.0, 0.0, GRS80),
    27700: lambda: TransverseMercator(49.0, -2.0, 0.9996012717, 400_000.0, -100_000.0, AIRY),
    28992: lambda: ObliqueStereographic(52 + 9 / 60 + 22.178 / 3600, 5 + 23 / 60 + 15.5 / 3600, 0.9999079, 155_000.0, 463_000.0, BESSEL),
    29873: lambda: HotineObliqueMercator(4.0, 115.0, 53 + 18 / 60 + 56.9537 / 3600, 53 + 7 / 60 + 48.3685 / 3600, 0.99984, 590_476.87, 442_857.65, EVEREST),
}


@dataclass(frozen=True)
class Datum:
    """Seven parameters that take geocentric places to WGS 84: shifts in metres, turns in seconds of arc (of the position vector), scale in millionths."""

    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)
    turn: tuple[float, float, float] = (0.0, 0.0, 0.0)
    scale: float = 0.0

    def matrix(self) -> list[list[float]]:
        x, y, z = (math.radians(v / 3600) for v in self.turn)
        return [[(1 + self.scale * 1e-6) * v for v in row] for row in ((1.0, -z, y), (z, 1.0, -x), (-y, x, 1.0))]

    def to_wgs84(self, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
        return tuple(t + m[0] * x + m[1] * y + m[2] * z for t, m in zip(self.shift, self.matrix()))

    def from_wgs84(self, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
        a, b, c = self.matrix()
        cross = lambda p, q: (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
        det = sum(u * v for u, v in zip(a, cross(b, c)))
        columns = (cross(b, c), cross(c, a), cross(a, b))
        moved = [v - t for v, t in zip((x, y, z), self.shift)]
        return tuple(sum((moved[k] * (columns[k][i] / det) for k in range(1, 3)), moved[0] * (columns[0][i] / det)) for i in range(3))


#: Of the systems whose datum isn't WGS 84 or one taken as equal to it.
DATUMS = {
    27700: Datum((446.448, -125.157, 542.060), (0.1502, 0.2470, 0.8421), -20.4894),
    28992: Datum((565.2369, 50.0087, 465.658), (-0.406857, 0.350733, -1.87035), 4.0812),
    29873: Datum((-533.4, 669.2, -52.5), (0.0, 0.0, 4.28), 9.4),
}
#: Metres of a unit of length.
UNITS = {"metre": 1.0, "foot": 0.3048, "us_foot": 1200 / 3937, "kilometre": 1000.0}


def system(code: int):
    """The projection of an EPSG code: those of ``SYSTEMS``, UTM on WGS 84 and ETRS89, three-degree zones on CGCS2000 by zone or by meridian."""
    if code in SYSTEMS:
        return SYSTEMS[code]()
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return TransverseMercator(0.0, code % 100 * 6 - 183.0, UTM_SCALE, UTM_EAST, UTM_SOUTH if code > 32700 else 0.0)
    if 25828 <= code <= 25838:
        return TransverseMercator(0.0, code % 100 * 6 - 183.0, UTM_SCALE, UTM_EAST, 0.0, GRS80)
    if 4513 <= code <= 4533:
        return TransverseMercator(0.0, (code - 4513 + 25) * 3.0, 1.0, (code - 4513 + 25) * 1e6 + UTM_EAST, 0.0, CGCS2000)
    if 4534 <= code <= 4554:
        return TransverseMercator(0.0, (code - 4534) * 3.0 + 75, 1.0, UTM_EAST, 0.0, CGCS2000)
    raise ValueError(f"unknown reference system {code}")


def geo_keys(code: int) -> dict[int, int]:
    """GeoTIFF keys of a code: the model type, and the code as a projected or geographic system."""
    return {1024: 2, 2048: code} if code == 4326 else {1024: 1, 3072: code}


def code_of_keys(keys: dict[int, int]) -> int | None:
    return keys.get(3072, keys.get(2048))


def utm_code(lon: Column, lat: Column) -> Column:
    """The EPSG code of the UTM zone of a place."""
    return (F.when(lat < 0, 32700).otherwise(32600) + utm_zone(lon)).cast("int")


def transformed(x: Column, y: Column, source: int, target: int, unit: str = "metre") -> tuple[Column, Column]:
    """Coordinates of one system in another one. Datums aren't shifted: longitude and latitude are taken as they are (``moved`` shifts them). unit: of the source's lengths."""
    lon, lat = system(source).inverse(x * UNITS[unit], y * UNITS[unit]) if source != 4326 else (x, y)
    return system(target).forward(lon, lat)


def moved(df: DataFrame, source: int, target: int, unit: str = "metre") -> DataFrame:
    """df with x and y of one system in another one, at height 0. Systems with seven parameters (``DATUMS``) are shifted from their datum or to it, through geocentric places
    on WGS 84; among the others longitude and latitude are taken as they are. Each step is a column of its own, so no expression is written out twice."""
    step = lambda d, names, columns: d.withColumns(dict(zip(names, columns)))
    own = system(source).inverse(F.col("x") * UNITS[unit], F.col("y") * UNITS[unit]) if source != 4326 else (F.col("x"), F.col("y"))
    df = step(df, ("_lon", "_lat"), own)
    if DATUMS.get(source) != DATUMS.get(target):
        on, to = (getattr(system(c), "e", WGS84) for c in (source, target))
        place = ("_gx", "_gy", "_gz")
        df = step(df, place, to_geocentric(F.col("_lon"), F.col("_lat"), F.lit(0.0), on))
        df = step(df, place, DATUMS.get(source, Datum()).to_wgs84(*map(F.col, place)))
        df = step(df, place, DATUMS.get(target, Datum()).from_wgs84(*map(F.col, place)))
        df = step(df, ("_lon", "_lat"), from_geocentric(*map(F.col, place), to)[:2]).drop(*place)
    return step(df, ("x", "y"), system(target).forward(F.col("_lon"), F.col("_lat"))).drop("_lon", "_lat")


def well_known_text(code: int) -> str:
    """A short description of a projected or geographic system that ends with its code, as files carry it."""
    if code == 4326:
        return 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4326"]]'
    p = system(code)
    kind = {"TransverseMercator": "Transverse_Mercator", "LambertConformalConic": "Lambert_Conformal_Conic_2SP", "AlbersEqualArea": "Albers_Conic_Equal_Area", "ObliqueStereographic": "Oblique_Stereographic", "HotineObliqueMercator": "Hotine_Oblique_Mercator_Azimuth_Center"}[type(p).__name__]
    return f'PROJCS["EPSG:{code}",GEOGCS["",SPHEROID["",{p.e.a!r},{1 / p.e.f!r}]],PROJECTION["{kind}"],PARAMETER["central_meridian",{p.lon0!r}],UNIT["metre",1],AUTHORITY["EPSG","{code}"]]'


def code_of_text(text: Column) -> Column:
    """The code that a system's description ends with, null if none does."""
    return F.nullif(F.regexp_extract(text, r'AUTHORITY\["EPSG","(\d+)"\]\]\s*$', 1), F.lit("")).cast("int")
