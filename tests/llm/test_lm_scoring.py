import math
from collections import Counter

import pytest

from spanlight.llm import lm_scoring as L

TEXTS = ["a b a b c", "A b a b c", "b c a", "", None, "z", "a b a b c", "a  b\nq q q q", "q q"]


def brute(texts, order, least=1, corpus=None):
    split = lambda rows: [(t or "").lower().split() for t in rows]
    docs, known = split(texts), split(texts if corpus is None else corpus)
    c = Counter(tuple(d[i : i + k]) for d in known for k in range(1, order + 1) for i in range(len(d) - k + 1))
    n = sum(map(len, known)) or 1

    def s(gram):
        if len(gram) == 1:
            return math.log(max(c[gram], 1) / n)
        if c[gram] >= least:
            return math.log(c[gram] / c[gram[:-1]])
        return math.log(0.4) + s(gram[1:])

    return [sum(s(tuple(d[max(0, i - order + 1) : i + 1])) for i in range(len(d))) if d else None for d in docs]


@pytest.mark.parametrize("order, least, bucket, block", [(1, 1, 4, 9), (2, 2, 4, 1), (3, 1, 3, 9), (3, 2, 2_000_000, 1 << 22)])
def test_against_brute_force(spark, monkeypatch, order, least, bucket, block):
    monkeypatch.setattr(L, "BUCKET", bucket)
    monkeypatch.setattr(L, "BLOCK", block)
    docs = spark.createDataFrame([(i if i < 7 else None, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x")], "doc_id long, text string, n_tokens string")
    want = brute([*TEXTS, TEXTS[0]], order, least)
    rows = L.scores(docs, order, least).collect()
    assert len(rows) == len(want)
    for r in rows:
        if r["doc_id"] is not None:
            assert r["log_score"] == (None if want[r["doc_id"]] is None else pytest.approx(want[r["doc_id"]]))
    assert sorted(r["log_score"] for r in rows if r["doc_id"] is None) == pytest.approx(sorted(want[7:9]))


def test_under_another_corpus(spark):
    corpus = ["a b c a b", "b c", None]
    known = spark.createDataFrame([(t,) for t in corpus], "text string")
    got = {r["doc_id"]: r["log_score"] for r in L.scores(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), corpus=known).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [None if x is None else pytest.approx(x) for x in brute(TEXTS, 3, 1, corpus)]
    assert L.scores(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), corpus=known.limit(0)).first()["log_score"] == pytest.approx(math.log(0.4))


def test_empty_table(spark):
    assert L.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_long_text(spark):
    text = " ".join(str(i % 977) for i in range(400_000))
    row = L.scores(spark.createDataFrame([("x", text)], "doc_id string, text string")).first()
    assert row["n_tokens"] == 400_000 and row["log_score"] == pytest.approx(brute([text], 3)[0])
