import collections
import random
import re

import numpy as np

from spanlight.llm import collocations as C, words
from spanlight.llm.hat_trie import HatTrie


def brute(rows, least, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update(("und" if lang is None else lang, *w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    n, found = collections.Counter(), collections.defaultdict(list)
    for (lang, *w), c in f.items():
        n[lang] += c if len(w) == 1 else 0
    for (lang, *w), a in f.items():
        if len(w) == 1 or a < least:
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang, rows_ in found.items():
        longer = [(p.split(b" "), -a) for _, a, p, _, _ in rows_ if p.count(b" ") == 2]
        inside = collections.Counter()
        for w, a in longer:
            for part in (tuple(w[:2]), tuple(w[1:])):
                inside[part] = max(inside[part], a)
        kept = sorted(r for r in rows_ if r[2].count(b" ") == 2 or 100 * inside[tuple(r[2].split(b" "))] < 50 * -r[1])
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(kept[:top], 1)]
    return sorted(out)


def sample(n=300):
    r = random.Random(4)
    common = ["The", "of", "é", "new", "york", "city", "a", "b", "x" * 70]
    text = lambda: "".join(r.choice(common) + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "! "]) for _ in range(r.randint(0, 60)))
    rows = [(r.choice(["en", "de", None, "und", ""]), text()) for _ in range(n)] + [("en", None), (None, ""), ("de", "New York City " * 30), ("q", "p p p p " * 9), ("en", "A b a Bİ " * 12)]
    return rows + rows[:40]


def collected(df):
    return sorted(tuple(r[k] for k in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_against_brute_force(spark):
    docs = spark.createDataFrame(sample(), "lang string, text string").repartition(5)
    assert collected(C.collocations(docs)) == brute(sample(), 10)
    assert collected(C.collocations(docs, least=3, top=7)) == brute(sample(), 3, 7)


def test_small_containers_and_spills(spark):
    r = np.random.default_rng(2)
    ids = r.zipf(1.3, (3, 20_000)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    trie, runs = HatTrie(burst=16, most=500), []
    for at in range(0, 20_000, 700):
        trie.put(ids[:, at : at + 700])
        runs += trie.spill()
    assert trie.root.size <= 500 and len(runs) > 10
    runs += trie.spill(everything=True)
    assert trie.root.size == 0
    got = collections.Counter()
    for keys, counts in runs:
        rows = list(zip(*keys.tolist()))
        assert rows == sorted(rows) and len(set(rows)) == len(rows)
        for k, c in zip(rows, counts.tolist()):
            got[k] += c
    assert got == collections.Counter(zip(*ids.tolist()))


def test_subtrees_of_a_common_prefix_burst_below_it():
    ids = np.stack([np.full(5000, 9, np.uint64), np.arange(5000, dtype=np.uint64)])
    trie = HatTrie(burst=64)
    trie.put(ids)
    trie.put(ids)
    below = [c for c in trie.root.children if not hasattr(c, "parts")]
    assert len(below) == 1 and below[0].level == 1 and len(below[0].children) > 50
    assert sum(int(c.sum()) for _, c in trie.spill(everything=True)) == 10_000


def test_colliding_ids_take_the_next_seed(spark, monkeypatch):
    real = words.table
    monkeypatch.setattr(words, "table", lambda seed: np.zeros(64 * 256, np.uint64) if seed == 1 else real(seed))
    docs = spark.createDataFrame(sample(60), "lang string, text string")
    assert collected(C.collocations(docs)) == brute(sample(60), 10)


def test_filter_lets_all_of_its_ids_through(spark):
    ids = [5, -7, 1 << 62, 0]
    bits = C.filter_of(spark.createDataFrame([(i,) for i in ids], "id long"))
    assert C.held(bits, np.array(ids, np.int64).view(np.uint64)).all()
    assert C.held(bits, np.arange(100, 1100, dtype=np.uint64)).sum() < 3


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), ("en", "a b c")], "lang string, text string")).count() == 0
