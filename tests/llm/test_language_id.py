import itertools
import math

import public_tokenizers as P
import pytest

from spanlight.llm import language_id as L


def every_segmentation(word, pieces, k):
    total = 0.0
    word = L.START + word
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        p = 1.0
        for a, b in zip(edges, edges[1:]):
            q = pieces.get(word[a:b])
            p *= q[k] if q else (L.UNKNOWN if b == a + 1 else 0.0)
        total += p
    return math.log(total)


def test_forward_sums_all_segmentations():
    pieces = {L.START: (0.1, 0.2), L.START + "a": (0.1, 0.3), "a": (0.2, 0.1), "ab": (0.05, 0.2), "b": (0.1, 0.1), "ba": (0.3, 0.01)}
    for word in ("ab", "abba", "baxab", "aaaa"):
        got = L.word_scores(word, pieces, 2)
        for k in (0, 1):
            assert got[k] == pytest.approx(every_segmentation(word, pieces, k))


def test_many_words_at_once():
    pieces = {L.START: (0.1, 0.2), L.START + "a": (0.1, 0.3), "a": (0.2, 0.1), "ab": (0.05, 0.2), "b": (0.1, 0.1), "baa": (0.3, 0.01)}
    words = ["ab", "abba", "baaxab", "a", "x", "aabaabaab" * 3]
    got = L.many_scores(words, L.Trie(list(pieces)), L.np.array([*pieces.values(), (L.UNKNOWN,) * 2]))
    for w, row in zip(words, got):
        assert list(row) == pytest.approx(L.word_scores(w, pieces, 2))


def test_long_words_do_not_underflow():
    pieces = {"a": (1e-4, 1e-5), L.START: (0.1, 0.1)}
    got = L.word_scores("a" * 3000, pieces, 2)
    assert got == pytest.approx([math.log(0.1) + 3000 * math.log(1e-4), math.log(0.1) + 3000 * math.log(1e-5)])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs.where(~L.held_out()), P.path(L.PIECES), sample=100)
    rows = [r for r in L.predict(docs.withColumn("held_out", L.held_out()), model).collect() if r["held_out"]]
    assert len(rows) > 100 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the the of", "en"), (2, "der die und", "de"), (3, None, None), (4, "12 %", "en"), (None, "the", "en"), (5, "the " + "x" * 500, None)], "doc_id long, text string, lang string")
    model = L.train(docs, P.path(L.PIECES))
    got = {r["doc_id"]: r["lang_pred"] for r in L.predict(docs, model).collect()}
    assert got[1] == "en" and got[2] == "de" and got[3] == got[4] == "und" and got[None] == "en"
    nothing = L.train(docs.limit(0), P.path(L.PIECES))
    assert {r["lang_pred"] for r in L.predict(docs, nothing).collect()} == {"und"} and L.predict(docs.limit(0), model).count() == 0


def test_expected_pieces_of_all_segmentations():
    pieces = {L.START: 0.1, L.START + "a": 0.2, "a": 0.2, "ab": 0.05, "b": 0.1, "baa": 0.3}
    for word in ("ab", "abba", "baaxab"):
        whole, want, total = L.START + word, {}, 0.0
        for cuts in itertools.product([0, 1], repeat=len(whole) - 1):
            edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(whole)]
            parts = [whole[a:b] for a, b in zip(edges, edges[1:])]
            p = math.prod(pieces.get(x, L.UNKNOWN if len(x) == 1 else 0.0) for x in parts)
            total += p
            for x in parts:
                want[x] = want.get(x, 0.0) + p
        got = L.expected_pieces(whole, L.Prefixed(pieces))
        assert got == pytest.approx({x: want[x] / total for x in got}) and all(x in got or x not in pieces or not p for x, p in want.items())
        many = L.many_expected([word, "b", word], L.np.array([2, 0, 1]), L.Trie(list(pieces)), L.np.array([*pieces.values(), L.UNKNOWN]))
        assert list(many / L.UNITS) == pytest.approx([3 * got.get(x, 0.0) for x in pieces], abs=1e-8)
    long = L.expected_pieces("ab" * 2000, L.Prefixed({"a": 1e-4, "ab": 1e-5, "b": 1e-4}))
    assert sum(len(x) * n for x, n in long.items()) == pytest.approx(4000)


def test_fit_takes_all_words_whole(spark):
    assert any(len(x) > 12 for x in L.vocabulary(P.path(L.PIECES)))
    many = " ".join(f"{i} {i}" for i in range(3100))
    texts = [("end", "z" * 60 + "j"), ("none", "z" * 61), ("rare", many + " j"), ("few", many)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = L.train(docs, P.path(L.PIECES))
    inner, first = (dict(zip(model["langs"], model["pieces"][x])) for x in ("j", L.START + "j"))
    assert inner["end"] > 2 * inner["none"] and first["rare"] > 2 * first["few"]


def test_trie_steps_against_prefixes():
    pieces = L.vocabulary(P.path(L.PIECES))
    trie, prefixes = L.Trie(pieces), {x[:i] for x in pieces for i in range(1, len(x) + 1)}
    place = {x: i for i, x in enumerate(pieces)}
    word = L.START + "überraschungsmomente\u4e2d\u3042"
    found = {(i, j): int(p[0]) for i, j, at, p in trie.edges([word[1:]])}
    for i in range(len(word)):
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in place:
                assert found[i, j] == place[word[i:j]]
            else:
                assert (i, j) not in found or j == i + 1 and found[i, j] == -1
    assert len(prefixes) + 1 == len(trie.piece_of)


def test_whole_prediction_against_brute_force(spark):
    """Posteriors of few pieces by all segmentations of all words, with priors; ties go to the first language."""
    pieces = {L.START: (0.1, 0.2, 0.2), L.START + "a": (0.1, 0.3, 0.3), "a": (0.2, 0.1, 0.1), "ab": (0.05, 0.2, 0.2), "b": (0.1, 0.1, 0.1)}
    model = {"langs": ["x", "y", "z"], "prior": [math.log(0.4), math.log(0.3), math.log(0.3)], "pieces": pieces}
    texts = ["ab a", "b b b b", "12 \u00bd \u00b2", None, "", "q", "a" * 40, "AB\nab"]
    rows = L.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        text = texts[r["doc_id"]]
        words = (text or "").lower().split()
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = [model["prior"][k] + sum(every_segmentation(w, pieces, k) if len(w) < 12 else L.word_scores(w, pieces, 3)[k] for w in words) for k in range(3)]
        assert r["lang_pred"] == "xyz"[logs.index(max(logs))]
        assert r["score"] == pytest.approx(1 / sum(math.exp(x - max(logs)) for x in logs))


def test_words_of_many_characters_take_time_by_their_length():
    import time

    pieces = {L.START: 0.2, "a": 0.1, "ab": 0.2, "abc": 0.1, "c": 0.1, "bcab": 0.3}
    word, began = "abcab" * 60_000, time.time()
    expected = L.expected_pieces(L.START + word, L.Prefixed(pieces))
    assert 0.5 * len(word) < sum(len(k) * v for k, v in expected.items()) < len(word) + 1.001
    scores = L.word_scores(word, {k: (v, v / 2) for k, v in pieces.items()}, 2)
    assert time.time() - began < 20 and scores[0] > scores[1]
    # as long as exact fractions can follow: the same sums without scaling
    from fractions import Fraction

    short = "abcab" * 150
    ahead = [Fraction(1)] + [Fraction(0)] * (len(short) + 1)
    full = L.START + short
    for i in range(len(full)):
        for k, v in pieces.items():
            if full.startswith(k, i):
                ahead[i + len(k)] += ahead[i] * Fraction(v)
        if full[i] not in pieces:
            ahead[i + 1] += ahead[i] * Fraction(L.UNKNOWN)
    log = lambda f: math.log(f.numerator) - math.log(f.denominator)
    assert abs(L.word_scores(short, {k: (v,) for k, v in pieces.items()}, 1)[0] - log(ahead[-1])) < 1e-6


def test_scaling_reaches_places_that_a_longer_piece_has_set():
    pieces = {"b": 1e-155, "bbb": 0.5, L.START: 1.0}
    got = L.word_scores("bbbb", {k: (v,) for k, v in pieces.items()}, 1)[0]
    assert abs(got - math.log(2 * 0.5 * 1e-155)) < 1e-6
