"""WARC: resolving not-modified revisits to the earlier full responses that they stand for.

A revisit (a 304 record) is joined as of its time by canonical URL to the latest strictly earlier full response (a 200 record). If the revisit has an
ETag it has to match the response's (weak comparison); else if it has a Last-Modified date that has to be equal; without validators the
response is taken as it is. Headers of the response are updated with those of the revisit that such an answer may carry.

The as-of join is two running maxima: within slices of time of each URL, and over the slices' last responses, so
the captures of one URL that holds most rows are spread over ``SLICES`` tasks. Slices are cut at quantiles of time.

Defined results: a revisit without URL or time, or without an earlier response, is unresolved (``no earlier response``); captures of
one time don't resolve each other, and of several responses at the latest time the one with the largest record_id counts; repeated records give repeated rows;
header names are lower-cased, of a name that comes twice the largest line counts; null headers are none; an empty table gives an empty result;
extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .frames import table

SLICES = 64
#: Headers of a not-modified answer that update the stored ones. Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't tell pages apart.
IGNORED = ("ref", "sessionid", "sid", "utm_campaign", "utm_medium", "utm_source")
URL = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without its last slashes, parameters sorted without ``IGNORED``; no scheme, user or fragment."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, URL, 2), r"/+$", "")
    given = F.filter(F.split(F.coalesce(F.regexp_extract(url, URL, 3), F.lit("")), "&"), lambda p: (p != "") & ~F.element_at(F.split(p, "="), 1).isin(*IGNORED))
    query = F.array_join(F.array_sort(given), "&")
    return F.when(host != "", F.concat(host, path, F.lit("?"), query))


def header(lines: Column, name: str) -> Column:
    """The value of a header in lines of ``name: value``."""
    found = F.filter(lines, lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))) == name)
    return F.trim(F.regexp_replace(F.array_max(found), r"^[^:]*:", ""))


def _named(lines: Column) -> Column:
    """Lines as (name, value) with names in lower case, each name once."""
    pairs = F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    sorted_ = F.array_sort(pairs)
    n = F.size(sorted_)
    return F.filter(sorted_, lambda p, i: (i == n - 1) | (F.try_element_at(sorted_, i + 2)["k"] != p["k"]))


def merged_headers(stored: Column, answered: Column) -> Column:
    """The stored lines, with those of a not-modified answer that may update them in place of theirs; sorted by name."""
    new = F.filter(_named(answered), lambda p: p["k"].isin(*PERMITTED))
    names = F.transform(new, lambda p: p["k"])
    old = F.filter(_named(stored), lambda p: ~F.array_contains(names, p["k"]))
    return F.transform(F.array_sort(F.concat(old, new)), lambda p: F.concat_ws(": ", p["k"], p["v"]))


def resolve(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """records with record_id, url, ts (long), status, headers (lines), digest -> a row for each revisit: record_id, url, ts,
    canonical, resolution, refers_to, digest (of the response's body), headers (merged; null if unresolved)."""
    kept = records.where(F.col("status").isin(200, 304)).select("record_id", "url", "ts", "status", "headers", "digest", canonical_url(F.col("url")).alias("canonical"))
    cuts = kept.where(F.col("ts").isNotNull()).approxQuantile("ts", [i / slices for i in range(1, slices)], 0.001) if slices > 1 else []
    cuts = sorted(set(cuts))
    part = F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda n, c: n + F.when(F.col("ts") > c, 1).otherwise(0)) if cuts else F.lit(0)
    placed = kept.where(F.col("canonical").isNotNull() & F.col("ts").isNotNull()).withColumn("slice", part)
    full = F.when(F.col("status") == 200, F.struct("ts", "record_id", "digest", "headers"))
    earlier = Window.partitionBy("canonical", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("near", F.max(full).over(earlier)).where("status = 304")
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("canonical", "slice").agg(F.max(full).alias("last")).withColumn("carried", F.max("last").over(before)).drop("last")
    found = inside.join(carried, ["canonical", "slice"], "left").withColumn("response", F.coalesce("near", "carried"))
    lost = kept.where("status = 304 and (canonical is null or ts is null)").withColumn("response", F.lit(None).cast(found.schema["response"].dataType))
    joined = found.select(*lost.columns).unionByName(lost)

    own, theirs = F.col("headers"), F.col("response.headers")
    weak = lambda v: F.regexp_replace(v, r"^W/", "")
    tag, date = header(own, "etag"), header(own, "last-modified")
    valid = F.when(tag.isNotNull(), F.coalesce(weak(tag) == weak(header(theirs, "etag")), F.lit(False))).when(date.isNotNull(), F.coalesce(date == header(theirs, "last-modified"), F.lit(False))).otherwise(True)
    resolution = F.when(F.col("response").isNull(), "no earlier response").when(valid, "resolved").otherwise("validators differ")
    done = joined.withColumn("resolution", resolution)
    if_resolved = lambda c: F.when(F.col("resolution") == "resolved", c)
    return done.select("record_id", "url", "ts", "canonical", "resolution", if_resolved(F.col("response.record_id")).alias("refers_to"), if_resolved(F.col("response.digest")).alias("digest"), if_resolved(merged_headers(theirs, own)).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl that Spark derives from pages: each page's capture at time 2 page_id (every eleventh failed), and a not-modified
    answer one later, with the page's ETag (every fifth a weak one, every seventh another page's, every third only a date)."""
    i, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    day = F.concat(F.lit("Last-Modified: day "), (F.floor(i / 10)).cast("string"))
    page = F.struct((2 * i).alias("record_id"), (2 * i).alias("ts"), F.when(i % 11 == 0, 503).otherwise(200).alias("status"),
                    F.array(F.lit("Content-Type: text/html"), F.concat(F.lit("ETag: "), tag), day, F.concat(F.lit("Content-Length: "), F.length(F.coalesce("html", F.lit(""))).cast("string"))).alias("headers"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    claimed = F.when(i % 7 == 0, F.lit('ETag: "other"')).when(i % 5 == 0, F.concat(F.lit("ETag: W/"), tag)).when(i % 3 == 0, day).otherwise(F.concat(F.lit("ETag: "), tag))
    answer = F.struct((2 * i + 1).alias("record_id"), (2 * i + 1).alias("ts"), F.lit(304).alias("status"), F.array(claimed, F.concat(F.lit("Date: "), i.cast("string")), F.lit("Content-Length: 0")).alias("headers"), F.lit(None).cast("string").alias("digest"))
    return pages.select("url", F.explode(F.array(page, answer)).alias("r")).select("url", "r.*")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html"))).withColumns({"headers": F.array_join("headers", "\n"), "refers_to": F.coalesce("refers_to", F.lit(-1))})


OP8_SQL = r"""
WITH u AS (
  SELECT page_id AS i, url, coalesce(html, '') AS html,
         lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?', 1)) AS host,
         regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?', 2) AS path,
         regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?', 3) AS query FROM pages),
c AS (
  SELECT i, url, html, CASE WHEN regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '^www\.', '') <> '' THEN
           regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '^www\.', '') || regexp_replace(path, '/+$', '') || '?' ||
           array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN ('ref', 'sessionid', 'sid', 'utm_campaign', 'utm_medium', 'utm_source'))), '&') END AS canonical,
         '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || CAST(i // 10 AS VARCHAR) AS day FROM u),
f AS (SELECT canonical, 2 * i AS ts, tag, day, md5(html) AS digest, length(html) AS n FROM c WHERE i % 11 <> 0 AND canonical IS NOT NULL),
r AS (SELECT *, 2 * i + 1 AS ts,
             CASE WHEN i % 7 = 0 THEN '"other"' WHEN i % 5 = 0 THEN 'W/' || tag WHEN i % 3 = 0 THEN NULL ELSE tag END AS claimed,
             CASE WHEN i % 7 <> 0 AND i % 5 <> 0 AND i % 3 = 0 THEN day END AS claimed_day FROM c),
j AS (SELECT r.*, f.ts AS ref, f.tag AS f_tag, f.day AS f_day, f.digest AS f_digest, f.n AS f_n
      FROM r ASOF LEFT JOIN f ON r.canonical = f.canonical AND r.ts > f.ts),
v AS (SELECT *, CASE WHEN ref IS NULL THEN 'no earlier response'
                     WHEN claimed IS NOT NULL AND regexp_replace(claimed, '^W/', '') = f_tag OR claimed IS NULL AND claimed_day = f_day THEN 'resolved'
                     ELSE 'validators differ' END AS resolution FROM j)
SELECT ts AS record_id, url, ts, canonical, resolution,
       CASE WHEN resolution = 'resolved' THEN ref ELSE -1 END AS refers_to, CASE WHEN resolution = 'resolved' THEN f_digest END AS digest,
       CASE WHEN resolution = 'resolved' THEN 'content-length: ' || CAST(f_n AS VARCHAR) || chr(10) || 'content-type: text/html' || chr(10) ||
            'date: ' || CAST(i AS VARCHAR) || chr(10) || 'etag: ' || coalesce(claimed, f_tag) || chr(10) || 'last-modified: ' || f_day END AS headers
FROM v
"""
