import hashlib
import random
import re

from spanlight.llm import substring_dedup as S


def brute(rows):
    first, split = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, _), w in zip(rows, split):
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, split):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def sample():
    r = random.Random(11)
    words = ["".join(r.choice("abcdeéß.X") for _ in range(r.randint(1, 6))) for _ in range(400)] + ["w" * 300, "w" * 301]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = prose(40), prose(300)
    out = [(5, ""), (6, None), (7, "one"), (8, base), (9, base), (3, base), (10, "a " * 50), (11, "a\t" * 30 + prose(10)), (None, base), (None, base)]
    out += [(100 + i, prose(r.randint(0, 30)) + r.choice([" ", "\n\x0b "]) + " ".join(passage.split()[r.randint(0, 20) :][: r.randint(10, 40)]) + " " + prose(r.randint(0, 30))) for i in range(60)]
    for i in range(40):
        near = base.split(" ")
        for _ in range(r.randint(1, 5)):
            near[r.randrange(len(near))] = r.choice(words)
        out.append((200 - i, " ".join(near)))
    out += [(300, base), (300, base), (300, base), (301, passage), (301, prose(20) + " " + passage), (302, passage + " " + passage), (303, " ".join(passage.split()[:12])), (304, " ".join(passage.split()))]
    r.shuffle(out)
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, N_words string, row long").repartition(6)
    out = S.deduplicated(docs)
    got = {r["row"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()}
    want = brute(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert out.columns == ["doc_id", "text", "row", "n_words", "n_removed", "kept_sha256"]
    return want


def test_against_brute_force(spark):
    assert sum(w[1] for w in check(spark, sample())) > 5000


def test_many_equal_rows_and_copies(spark):
    r = random.Random(2)
    text = " ".join(str(r.randrange(50)) for _ in range(200))
    want = check(spark, [(4, text)] * 300 + [(i, text) for i in range(5, 200)] + [(2, text[:300])])
    assert want[0][1] and want[-1][1] == 0


def test_long_words_and_whole_texts(spark):
    check(spark, [(1, "q" * 100_000 + " " + "r " * 40), (2, "q" * 100_000 + " " + "r " * 40), (3, "q" * 99_999 + " " + "r " * 13), (4, "x " * 30_000), (5, "x " * 13)])


def test_empty(spark):
    assert S.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_that_differ_from_their_source_stay():
    words = [b"%d" % i for i in range(20)]
    assert S.removed_words(words, [(0, 8, 0, 20, 1, b" ".join([b"x", *words[:15], b"other", *words[16:]]))]).tolist() == [True] * 15 + [False] * 5
    assert S.removed_words(words, [(0, 8, 0, 20, 1, b" ".join([b"x", *words]))]).all()


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.op13_substring_dedup(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted((i, *w) for (i, _), w in zip(rows, brute(rows)))
