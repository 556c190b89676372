import random

from pyspark.sql import functions as F

from spanlight.llm import warc as W

SCHEMA = "record_id long, url string, ts long, status int, headers array<string>, digest string, slice string"


def test_canonical_urls(spark):
    rows = {
        "HTTP://WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#frag": "example.com/a/b?a=1&b=2",
        "https://user:pw@example.com/a/b?a=1&b=2": "example.com/a/b?a=1&b=2",
        "example.com": "example.com?",
        "http://example.com:8080/": "example.com:8080?",
        "": None,
        None: None,
    }
    got = spark.createDataFrame([(u,) for u in rows], "u string").select("u", W.canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in got} == rows


def test_headers_and_validators(spark):
    a, b = ['ETag: "1"', "X-Own: y", "content-type: text/html", "Date: 1"], ['etag: W/"1"', "DATE: 2", "Content-Type: evil", "X-New: z"]
    rows = [
        (1, "http://h/p", 10, 200, a, "d1", "x"),
        (2, "https://www.h/p/", 20, 304, b, None, "x"),
        (3, "http://h/p", 20, 304, ['ETag: "2"'], None, "x"),
        (4, "http://h/p", 10, 304, None, None, "x"),
        (5, "http://h/p", 30, 304, None, None, "x"),
        (6, None, 30, 304, None, None, "x"),
        (7, "http://h/p", None, 304, None, None, "x"),
        (8, "http://h/p", 25, 404, None, "e", "x"),
        (9, "http://h/p", 31, 304, ["Last-Modified: never"], None, "x"),
    ]
    got = {r["record_id"]: r for r in W.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2]["refers_to"] == 1 and got[2]["headers"] == ["content-type: text/html", "date: 2", 'etag: W/"1"', "x-own: y"]
    assert [got[i]["resolution"] for i in (3, 9)] == ["validators differ"] * 2
    assert [got[i]["resolution"] for i in (4, 6, 7)] == ["no earlier response"] * 3
    assert got[5]["refers_to"] == 1 and got[5]["digest"] == "d1"
    assert W.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_as_of_join_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, f"http://h/{r.choice('aaaaaab')}", r.randint(0, 60), r.choice([200, 304]), None, str(i), "x") for i in range(300)]
    for slices in (1, 7):
        got = {x["record_id"]: x["refers_to"] for x in W.resolve(spark.createDataFrame(rows, SCHEMA), slices).collect()}
        for i, url, ts, status, *_ in rows:
            if status == 304:
                assert got[i] == max(((t, j) for j, u, t, s, *_ in rows if s == 200 and u == url and t < ts), default=(0, None))[1]
