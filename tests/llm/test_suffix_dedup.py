import hashlib
import random

from pyspark.sql import functions as F

from spanlight.llm import suffix_dedup as S


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for i in range(len(raw) - 199):
            w = raw[i : i + 200]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgé ") for _ in range(r.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = prose(60), prose(150)
    out = ["", None, "short", base, base, "z" * 700, "ab" * 400 + prose(20), passage[:200], passage[:199]]
    out += [prose(r.randint(1, 40)) + passage[r.randint(0, 120) :][: r.randint(150, 400)] + prose(r.randint(1, 40)) for _ in range(40)]
    for _ in range(30):
        near = base.split(" ")
        for _ in range(r.randint(1, 6)):
            near[r.randrange(len(near))] = r.choice(words)
        out.append(" ".join(near))
    out.append(passage + prose(30) + passage)
    return out


def check(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_bytes string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.deduplicated(docs, **how).collect()}
    want = brute(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert any(w[1] for w in want)


def test_against_brute_force(spark):
    check(spark, texts())


def test_many_batches_and_hot_suffixes(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    check(spark, texts(), batches=7)


def test_levels_merge_geometrically(spark):
    index = S.SuffixIndex(S.Stage(spark, "levels"))
    for b in range(7):
        got = {tuple(r) for r in index.add(spark.createDataFrame([(b, b), (9, 9), (9, 9)], "head long, key long")).collect()}
        assert got == {(9, 9)}
    assert [size for size, _, _ in index.levels] == [4, 2, 1]


def test_empty_and_repeated_rows(spark):
    assert S.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = S.deduplicated(spark.createDataFrame([(None, "q" * 150 + "w" * 150)] * 2, "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in twice] == [300, 300] and [r["text"] for r in twice] == ["", ""]


def test_equal_rows_are_not_gathered(spark):
    r = random.Random(8)
    text = " ".join(str(r.randrange(10**6)) for _ in range(300))
    docs = spark.createDataFrame([(1, text)] * 10_000, "doc_id long, text string")
    stage = S.Stage(spark, "equal")
    found = S.repeated_windows(docs, stage)
    lists = found.groupBy("doc_id", "print").agg(S.F.collect_set(S.F.struct("first", "last")).alias("runs")).collect()
    assert len(lists) == 1 and len(lists[0]["runs"]) < 100
    out = S.deduplicated(docs).groupBy("n_removed").count().collect()
    assert [(x["n_removed"], x["count"]) for x in out] == [(len(text), 10_000)]
