"""Queries of scalar functions: strings and paths, geometry, curves, robust weights, map projections."""

from pyspark.sql import functions as F

from ..functions import crs, geometry as g, strings as s
from ..sources.points import KEY, P, points
from .filter_queries import K
from .registry import query


def parts(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name")


def urls(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")


@query("n1_trim", "SELECT p_partkey, trim('  ' || p_name || ' ') AS a, ltrim('..' || p_name, '.') AS b, rtrim(p_name || '--', '-') AS c FROM part")
def n1(spark, sf):
    n = F.col("p_name")
    return parts(spark, sf).select("p_partkey", F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("a"), F.ltrim(F.concat(F.lit(".."), n), F.lit(".")).alias("b"), F.rtrim(F.concat(n, F.lit("--")), F.lit("-")).alias("c"))


@query("n2_find", "SELECT p_partkey, CAST(instr(p_name, 'a') - 1 AS INT) AS first, CAST(CASE WHEN instr(reverse(p_name), 'a') > 0 THEN length(p_name) - instr(reverse(p_name), 'a') ELSE -1 END AS INT) AS last, CAST(coalesce(least(nullif(instr(p_name, 'e'), 0), nullif(instr(p_name, 'o'), 0)) - 1, -1) AS INT) AS any_of, substring(p_name, 3, 4) AS mid, left(p_name, 3) AS l, right(p_name, 3) AS r FROM part")
def n2(spark, sf):
    n = F.col("p_name")
    return parts(spark, sf).select("p_partkey", s.find(n, "a").alias("first"), s.reverse_find(n, "a").alias("last"), s.find_one_of(n, "eo").alias("any_of"), s.mid(n, 2, 4).alias("mid"), s.left(n, 3).alias("l"), s.right(n, 3).alias("r"))


@query("n3_edit", "SELECT p_partkey, replace(p_name, 'e', 'EE') AS a, translate(p_name, 'o', '') AS b, substring(p_name, 1, 2) || '++' || substring(p_name, 3) AS c, substring(p_name, 1, 1) || substring(p_name, 4) AS d, upper(p_name) AS e, lower(p_name) AS f, reverse(p_name) AS g FROM part")
def n3(spark, sf):
    n = F.col("p_name")
    return parts(spark, sf).select("p_partkey", F.replace(n, F.lit("e"), F.lit("EE")).alias("a"), s.remove(n, "o").alias("b"), s.insert(n, 2, "++").alias("c"), s.delete(n, 1, 2).alias("d"), F.upper(n).alias("e"), F.lower(n).alias("f"), F.reverse(n).alias("g"))


@query("n4_compare_and_span", "SELECT p_partkey, lower(p_name) = lower(upper(p_name)) AS same, regexp_extract(p_name, '^[a-z]*', 0) AS a, regexp_extract(p_name, '^[^ #]*', 0) AS b, printf('%s:%05d', left(p_name, 2), p_partkey) AS f FROM part")
def n4(spark, sf):
    n = F.col("p_name")
    return parts(spark, sf).select("p_partkey", (F.lower(n) == F.lower(F.upper(n))).alias("same"), s.span_including(n, "abcdefghijklmnopqrstuvwxyz").alias("a"), s.span_excluding(n, " #").alias("b"), F.format_string("%s:%05d", s.left(n, 2), "p_partkey").alias("f"))


@query("n5_words", "SELECT p_partkey, CAST(len(list_filter(string_split(p_name, ' '), lambda w: w <> '')) AS INT) AS n, coalesce(list_filter(string_split(p_name, ' '), lambda w: w <> '')[2], '') AS second FROM part")
def n5(spark, sf):
    return parts(spark, sf).select("p_partkey", s.count_words(F.col("p_name")).alias("n"), s.word(F.col("p_name"), 1).alias("second"))


@query("n6_numbers", "SELECT p_partkey, coalesce(regexp_full_match(t, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?'), false) AS is_number, try_cast(t AS DOUBLE) AS v, CASE WHEN contains(t, '.') THEN regexp_replace(regexp_replace(t, '0+$', ''), '\\.$', '') ELSE t END AS trimmed FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_partkey || '.500' ELSE '-' || p_partkey || '.000' END AS t FROM part)")
def n6(spark, sf):
    t = parts(spark, sf).selectExpr("p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_partkey || '.500' ELSE '-' || p_partkey || '.000' END AS t")
    return t.select("p_partkey", s.is_number(F.col("t")).alias("is_number"), F.col("t").try_cast("double").alias("v"), s.trim_number(F.col("t")).alias("trimmed"))


@query("n7_compare_versions", "WITH v AS (SELECT p_partkey, p_partkey % 3 AS a1, p_partkey % 7 AS a2, p_partkey % 2 AS b1, p_partkey % 11 AS b2 FROM part) SELECT p_partkey, CASE WHEN a1 < b1 THEN -1 WHEN a1 > b1 THEN 1 WHEN a2 < b2 THEN -1 WHEN a2 > b2 THEN 1 ELSE 0 END AS c FROM v")
def n7(spark, sf):
    k = F.col("p_partkey")
    v = lambda a, b: F.concat_ws(".", (k % a).cast("string"), (k % b).cast("string"))
    return parts(spark, sf).select("p_partkey", s.compare_versions(v(3, 7), v(2, 11)).alias("c"))


@query("n8_special_characters", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]', '_', 'g') AS safe, CAST(octet_length(encode(url)) AS INT) AS bytes FROM pages")
def n8(spark, sf):
    return urls(spark, sf).select("page_id", F.regexp_replace("url", "[^A-Za-z0-9]", "_").alias("safe"), F.octet_length("url").alias("bytes"))


@query("n9_after_and_starts", "SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE url END AS after, starts_with(url, 'https') AS secure FROM pages")
def n9(spark, sf):
    u = F.col("url")
    return urls(spark, sf).select("page_id", F.when(F.instr(u, "://") > 0, s.mid(u, 0).substr(F.instr(u, "://") + 3, F.length(u))).otherwise(u).alias("after"), u.startswith("https").alias("secure"))


@query("n10_csv", "SELECT vec_id, array_to_string(list_transform(string_split(CAST(vec_id AS VARCHAR) || ', ' || label || ',7', ','), lambda v: CAST(CAST(trim(v) AS BIGINT) AS VARCHAR)), ', ') AS csv FROM embeddings")
def n10(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    text = F.concat(F.col("vec_id").cast("string"), F.lit(", "), F.col("label").cast("string"), F.lit(",7"))
    return e.select("vec_id", s.to_csv_text(F.transform(s.csv_numbers(text), lambda v: v.cast("long"))).alias("csv"))


@query("n11_paths", "SELECT page_id, regexp_extract(path, '(\\.[^./\\\\]*)$', 1) AS ext, regexp_extract(regexp_replace(path, '[/\\\\]+$', ''), '([^/\\\\]*)$', 1) AS base, regexp_replace(regexp_replace(path, '[/\\\\]+$', ''), '[/\\\\]?[^/\\\\]*$', '') AS parent, regexp_replace('root/', '/+$', '') || '/' || regexp_replace(path, '^/+', '') AS joined FROM (SELECT page_id, '/' || regexp_replace(url, '^[a-z]+://', '') || CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '' END AS path FROM pages)")
def n11(spark, sf):
    path = F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://", ""), F.when(F.col("page_id") % 2 == 0, ".html").otherwise(""))
    p = urls(spark, sf).select("page_id", path.alias("path"))
    c = F.col("path")
    return p.select("page_id", s.extension(c).alias("ext"), s.base_name(c).alias("base"), s.parent(c).alias("parent"), s.joined_path(F.lit("root/"), c).alias("joined"))


@query("n12_format_bytes", "WITH d AS (SELECT doc_id, n_chars * 1000 AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1024**4 THEN printf('%.2f TB', round(n / 1024.0**4, 2)) WHEN n >= 1024**3 THEN printf('%.2f GB', round(n / 1024.0**3, 2)) WHEN n >= 1024**2 THEN printf('%.2f MB', round(n / 1024.0**2, 2)) WHEN n >= 1024 THEN printf('%.2f KB', round(n / 1024.0, 2)) ELSE printf('%d B', n) END AS size FROM d")
def n12(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", s.format_bytes(F.col("n_chars") * 1000).alias("size"))


@query("g1_segments_cross", f"WITH {P} SELECT {K}, ((600.0*(y-100)-500.0*(x-100))*(600.0*(z*10-100)-500.0*(y-100)) < 0) AND ((y-x)*(100-y)-(z*10-y)*(100-x))*((y-x)*(600-y)-(z*10-y)*(700-x)) < 0 AS cross_ FROM p")
def g1(spark, sf):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return points(spark, sf).select(*KEY, g.segments_cross(100, 100, 700, 600, x, y, y, z * 10).alias("cross_"))


SEG = "greatest(0, least(1, ((x - 100) * 600.0 + (y - 50) * 700.0) / 850000.0))"


@query("g2_squared_segment_distance", f"WITH {P}, t AS (SELECT *, {SEG} AS t FROM p) SELECT {K}, round((x - (100 + t * 600)) ** 2 + (y - (50 + t * 700)) ** 2, 6) AS d2 FROM t")
def g2(spark, sf):
    return points(spark, sf).select(*KEY, F.round(g.squared_segment_distance(F.col("x"), F.col("y"), 100, 50, 700, 750), 6).alias("d2"))


@query("g3_near_segment", f"WITH {P}, t AS (SELECT *, {SEG} AS t FROM p) SELECT {K} FROM t WHERE sqrt((x - (100 + t * 600)) ** 2 + (y - (50 + t * 700)) ** 2) <= 20")
def g3(spark, sf):
    return points(spark, sf).where(F.sqrt(g.squared_segment_distance(F.col("x"), F.col("y"), 100, 50, 700, 750)) <= 20).select(*KEY)


@query("g5_barycentric", f"WITH {P}, b AS (SELECT {K}, (400.0*(x-900)+300.0*(y-100)) / (-320000.0) AS u, (-800.0)*(y-100) / (-320000.0) AS v FROM p) SELECT {K}, round(u * 10 + v * 50 + (1 - u - v) * 30, 3) AS h FROM b WHERE u >= 0 AND v >= 0 AND 1 - u - v >= 0")
def g5(spark, sf):
    h = g.barycentric(F.col("x"), F.col("y"), (100.0, 100.0, 10.0), (600.0, 500.0, 50.0), (900.0, 100.0, 30.0))
    return points(spark, sf).withColumn("h", h).where(F.col("h") < float("inf")).select(*KEY, F.round("h", 3).alias("h"))


@query("g6_curve_distance", f"WITH {P} SELECT {K}, round(sqrt((x - 300)**2 + (z - (0.0001*y*y - 0.1*y + 60))**2), 6) AS d FROM p WHERE y BETWEEN 100 AND 800")
def g6(spark, sf):
    curve = {"x0": 300.0, "a": 0.0001, "b": -0.1, "c": 60.0, "y_min": 100.0, "y_max": 800.0}
    d = g.curve_distance(F.col("x"), F.col("y"), F.col("z"), curve)
    return points(spark, sf).withColumn("d", d).where(F.col("d") < float("inf")).select(*KEY, F.round("d", 6).alias("d"))


@query("g7_clamp", f"WITH {P} SELECT {K}, least(greatest(z, 20.0), 60.0) AS c, CAST(round(x) AS BIGINT) AS r FROM p")
def g7(spark, sf):
    return points(spark, sf).select(*KEY, g.clamp(F.col("z"), 20, 60).alias("c"), F.round("x").cast("long").alias("r"))


RES = "abs(z - 50) / 10.0 + 0.01"


@query("g8_robust_weights", f"WITH {P}, r AS (SELECT z, {RES} AS r FROM p) SELECT z, round(any_value(0.7 / power(r, 1.3)), 8) AS pnorm, round(any_value(CASE WHEN r > 3 THEN 0 ELSE power(1 - (r / 3) * (r / 3), 2) END), 8) AS tukey, round(any_value(1 / (1 + r / 2)), 8) AS fair, round(any_value(tanh(r / 2) / (r / 2)), 8) AS logistic, any_value(CASE WHEN r > 2 THEN 0.0 ELSE 1.0 END)::DOUBLE AS trimmed, round(any_value(exp(-(r / 2) * (r / 2) / 2)), 8) AS welsch FROM r GROUP BY z")
def g8(spark, sf):
    r = F.abs(F.col("z") - 50) / 10.0 + 0.01
    kinds = {"pnorm": 0.7, "tukey": 3.0, "fair": 2.0, "logistic": 2.0, "trimmed": 2.0, "welsch": 2.0}
    return points(spark, sf).select("z").distinct().select("z", *[F.round(g.robust_weight(r, k, p), 8).alias(k) for k, p in kinds.items()])


@query("g9_crown_radius", f"WITH {P} SELECT DISTINCT z, round(CASE WHEN z < 10 THEN 1.0 WHEN z > 60 THEN 5.0 ELSE 4.0 / (1 - exp(-0.08 * 50)) * (1 - exp(-0.08 * (z - 10))) + 1 END, 8) AS r FROM p")
def g9(spark, sf):
    return points(spark, sf).select("z").distinct().select("z", F.round(g.crown_radius(F.col("z"), 10, 60, 1, 5), 8).alias("r"))


def places(spark, sf):
    """Longitudes and latitudes of the suppliers."""
    return spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey", "(s_suppkey * 37 % 3590) / 10.0D - 179.5D AS lon", "(s_suppkey * 13 % 1590) / 10.0D - 79.5D AS lat")


PLACES = "t AS (SELECT s_suppkey, (s_suppkey * 37 % 3590) / 10.0 - 179.5 AS lon, (s_suppkey * 13 % 1590) / 10.0 - 79.5 AS lat FROM supplier)"


@query("x1_utm_round_trip", f"WITH {PLACES} SELECT s_suppkey, CAST(floor((lon + 180) / 6) % 60 + 1 AS INT) AS zone, round(lon, 5) AS lon, round(lat, 5) AS lat FROM t")
def x1(spark, sf):
    zone, x, y = crs.to_utm(F.col("lon"), F.col("lat"))
    t = places(spark, sf).select("s_suppkey", zone.alias("zone"), x.alias("x"), y.alias("y"), (F.col("lat") < 0).alias("south"))
    lon, lat = crs.from_utm(F.col("zone"), F.col("x"), F.col("y"), F.col("south"))
    return t.select("s_suppkey", "zone", (F.round(lon, 5) + 0.0).alias("lon"), (F.round(lat, 5) + 0.0).alias("lat"))


@query("x2_lambert_round_trip", f"WITH {PLACES} SELECT s_suppkey, round(lon / 10, 6) AS lon, round(30 + abs(lat) / 4, 6) AS lat FROM t")
def x2(spark, sf):
    p = crs.LambertConformalConic(30.0, 60.0, 40.0, 5.0, 1000.0, 2000.0)
    t = places(spark, sf).select("s_suppkey", (F.col("lon") / 10).alias("lon"), (30 + F.abs("lat") / 4).alias("lat"))
    x, y = p.forward(F.col("lon"), F.col("lat"))
    lon, lat = p.inverse(F.col("x"), F.col("y"))
    return t.select("s_suppkey", x.alias("x"), y.alias("y")).select("s_suppkey", (F.round(lon, 6) + 0.0).alias("lon"), F.round(lat, 6).alias("lat"))


@query("x4_geocentric", f"WITH {PLACES}, r AS (SELECT *, radians(lat) AS p, radians(lon) AS q, 6378137.0 / sqrt(1 - 0.006694379990141316 * sin(radians(lat)) ** 2) AS n FROM t) SELECT s_suppkey, round((n + 100) * cos(p) * cos(q), 3) AS x, round((n + 100) * cos(p) * sin(q), 3) AS y, round((n * (1 - 0.006694379990141316) + 100) * sin(p), 3) AS z FROM r")
def x4(spark, sf):
    return places(spark, sf).select("s_suppkey", *[F.round(c, 3).alias(n) for c, n in zip(crs.to_geocentric(F.col("lon"), F.col("lat"), F.lit(100.0)), "xyz")])


@query("x4_geocentric_round_trip", f"WITH {PLACES} SELECT s_suppkey, round(lon, 7) AS lon, round(lat, 7) AS lat FROM t")
def x4_back(spark, sf):
    x, y, z = crs.to_geocentric(F.col("lon"), F.col("lat"), F.lit(100.0))
    t = places(spark, sf).select("s_suppkey", x.alias("x"), y.alias("y"), z.alias("z"))
    lon, lat, _ = crs.from_geocentric(F.col("x"), F.col("y"), F.col("z"))
    return t.select("s_suppkey", (F.round(lon, 7) + 0.0).alias("lon"), (F.round(lat, 7) + 0.0).alias("lat"))


@query("x5_albers_round_trip", f"WITH {PLACES} SELECT s_suppkey, round(lon / 10, 6) AS lon, round(30 + abs(lat) / 4, 6) AS lat FROM t")
def x5(spark, sf):
    p = crs.AlbersEqualArea(29.5, 45.5, 37.5, 5.0)
    t = places(spark, sf).select("s_suppkey", (F.col("lon") / 10).alias("lon"), (30 + F.abs("lat") / 4).alias("lat"))
    x, y = p.forward(F.col("lon"), F.col("lat"))
    lon, lat = p.inverse(F.col("x"), F.col("y"))
    return t.select("s_suppkey", x.alias("x"), y.alias("y")).select("s_suppkey", (F.round(lon, 6) + 0.0).alias("lon"), F.round(lat, 6).alias("lat"))


#: Easting and northing of transverse Mercator by its series, of l(id, lon, lat), for a, e2, lon0, k, FE, FN: tm(id, x, y).
TM_SQL = """c AS (SELECT id, radians(lat) AS f, cos(radians(lat)) * radians(lon - {lon0}) AS w, {e2} / (1 - {e2}) * cos(radians(lat))**2 AS c, tan(radians(lat))**2 AS t, {a} / sqrt(1 - {e2} * sin(radians(lat))**2) AS nu FROM l),
 tm AS (SELECT id, {fe} + {k} * nu * (w + (1 - t + c) * w**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * {e2} / (1 - {e2})) * w**5 / 120) AS x,
 {fn} + {k} * ({a} * ((1 - {e2} / 4 - 3 * {e2}**2 / 64 - 5 * {e2}**3 / 256) * f - (3 * {e2} / 8 + 3 * {e2}**2 / 32 + 45 * {e2}**3 / 1024) * sin(2 * f) + (15 * {e2}**2 / 256 + 45 * {e2}**3 / 1024) * sin(4 * f) - 35 * {e2}**3 / 3072 * sin(6 * f))
 + nu * tan(f) * (w**2 / 2 + (5 - t + 9 * c + 4 * c**2) * w**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * {e2} / (1 - {e2})) * w**6 / 720)) AS y FROM c)"""
WGS_E2 = "0.0066943799901413165"


@query("x3_transverse_mercator", f"WITH {PLACES}, l AS (SELECT s_suppkey AS id, 114 + lon / 120 AS lon, lat / 2 AS lat FROM t), {TM_SQL.format(a='6378137.0', e2='0.006694380022900787', lon0='114', k='1.0', fe='38500000.0', fn='0.0')} SELECT id AS s_suppkey, round(x, 3) AS x, round(y, 3) AS y FROM tm")
def x3(spark, sf):
    """Three-degree zone 38 on CGCS2000, forward."""
    x, y = crs.system(4526).forward(114 + F.col("lon") / 120, F.col("lat") / 2)
    return places(spark, sf).select("s_suppkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("x1_utm_forward", f"WITH {PLACES}, z AS (SELECT *, floor((lon + 180) / 6) % 60 + 1 AS zone FROM t), l AS (SELECT s_suppkey AS id, lon - (zone * 6 - 183) AS lon, lat FROM z), {TM_SQL.format(a='6378137.0', e2=WGS_E2, lon0='0', k='0.9996', fe='500000.0', fn='0.0')} SELECT s_suppkey, CAST(zone AS INT) AS zone, round(x, 3) AS x, round(CASE WHEN lat < 0 THEN y + 10000000 ELSE y END, 3) AS y FROM tm JOIN z ON id = s_suppkey")
def x1_forward(spark, sf):
    zone, x, y = crs.to_utm(F.col("lon"), F.col("lat"))
    return places(spark, sf).select("s_suppkey", zone.alias("zone"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def there_and_back(spark, sf, code, lon, lat):
    """Places around a system's centre, projected and back; forward values are tested against published examples."""
    p, at = crs.system(code), places(spark, sf).select("s_suppkey", (lon + F.col("lon") / 120).alias("lon"), (lat + F.col("lat") / 120).alias("lat"))
    x, y = p.forward(F.col("lon"), F.col("lat"))
    lon, lat = p.inverse(F.col("x"), F.col("y"))
    return at.select("s_suppkey", x.alias("x"), y.alias("y")).select("s_suppkey", (F.round(lon, 7) + 0.0).alias("lon"), (F.round(lat, 7) + 0.0).alias("lat"))


AROUND = "WITH " + PLACES + " SELECT s_suppkey, round({0} + lon / 120, 7) AS lon, round({1} + lat / 120, 7) AS lat FROM t"


@query("x5_oblique_stereographic_round_trip", AROUND.format(5.4, 52.2))
def x5_stereographic(spark, sf):
    return there_and_back(spark, sf, 28992, 5.4, 52.2)


@query("x5_hotine_round_trip", AROUND.format(115.0, 4.0))
def x5_hotine(spark, sf):
    return there_and_back(spark, sf, 29873, 115.0, 4.0)


@query("x6_utm_codes", f"WITH {PLACES} SELECT s_suppkey, CAST(CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + floor((lon + 180) / 6) % 60 + 1 AS INT) AS code FROM t")
def x6(spark, sf):
    return places(spark, sf).select("s_suppkey", crs.utm_code(F.col("lon"), F.col("lat")).alias("code"))


@query("x7_to_longitude_latitude", AROUND.format(3.0, 46.5))
def x7(spark, sf):
    """From feet on a conic grid to longitude and latitude."""
    x, y = crs.transformed(3.0 + F.col("lon") / 120, 46.5 + F.col("lat") / 120, 4326, 2154)
    at = places(spark, sf).select("s_suppkey", (x / 0.3048).alias("x"), (y / 0.3048).alias("y"))
    lon, lat = crs.transformed(F.col("x"), F.col("y"), 2154, 4326, "foot")
    return at.select("s_suppkey", (F.round(lon, 7) + 0.0).alias("lon"), (F.round(lat, 7) + 0.0).alias("lat"))


@query("x8_between_systems", f"WITH {PLACES}, l AS (SELECT s_suppkey AS id, 3.0 + lon / 120 AS lon, 46.5 + lat / 120 AS lat FROM t), {TM_SQL.format(a='6378137.0', e2=WGS_E2, lon0='3', k='0.9996', fe='500000.0', fn='0.0')} SELECT id AS s_suppkey, round(x, 3) AS x, round(y, 3) AS y FROM tm")
def x8(spark, sf):
    """Conic grid to UTM zone 31."""
    x, y = crs.transformed(3.0 + F.col("lon") / 120, 46.5 + F.col("lat") / 120, 4326, 2154)
    at = places(spark, sf).select("s_suppkey", x.alias("x"), y.alias("y"))
    x, y = crs.transformed(F.col("x"), F.col("y"), 2154, 32631)
    return at.select("s_suppkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


AIRY_E2 = repr(crs.AIRY.e2)
HELMERT = [[repr(v) for v in row] for row in crs.DATUMS[27700].matrix()]


@query("x8_datum_shift", f"WITH {PLACES}, r AS (SELECT *, radians(lat) AS p, radians(lon) AS q, 6377563.396 / sqrt(1 - {AIRY_E2} * sin(radians(lat)) ** 2) AS n FROM t), g AS (SELECT s_suppkey, (n + 100) * cos(p) * cos(q) AS x, (n + 100) * cos(p) * sin(q) AS y, (n * (1 - {AIRY_E2}) + 100) * sin(p) AS z FROM r) SELECT s_suppkey, "
       + ", ".join(f"round({t} + x * {m[0]}::DOUBLE + y * {m[1]}::DOUBLE + z * {m[2]}::DOUBLE, 3) AS {c}" for t, m, c in zip(("446.448", "-125.157", "542.060"), HELMERT, "xyz")) + " FROM g")
def x8_shift(spark, sf):
    """Places on one datum as geocentric ones on WGS 84."""
    g = crs.DATUMS[27700].to_wgs84(*crs.to_geocentric(F.col("lon"), F.col("lat"), F.lit(100.0), crs.AIRY))
    return places(spark, sf).select("s_suppkey", *[F.round(c, 3).alias(n) for c, n in zip(g, "xyz")])


@query("x8_datum_round_trip", f"WITH {PLACES} SELECT s_suppkey, round(155000 + lon * 100, 2) AS x, round(463000 + lat * 100, 2) AS y FROM t")
def x8_round_trip(spark, sf):
    """Coordinates of a national grid in UTM on WGS 84 and back, with the shift of the datum both ways; the height between, which is dropped, moves them by a millimetre."""
    at = places(spark, sf).select("s_suppkey", (155_000 + F.col("lon") * 100).alias("x"), (463_000 + F.col("lat") * 100).alias("y"))
    back = crs.moved(crs.moved(at, 28992, 32631), 32631, 28992)
    return back.select("s_suppkey", *[F.round(c, 2).alias(c) for c in "xy"])
