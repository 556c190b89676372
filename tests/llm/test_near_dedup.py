import random

import corpus_pipeline
import pytest
from spanlight.llm import near_dedup as N


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < 3 else set(zip(words, words[1:], words[2:]))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(400)]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    out = ["", None, "One", "one ", "one two", "Éa b c", "éa b c"]
    for _ in range(25):
        base = prose(r.randint(20, 120))
        out.append(" ".join(base))
        for _ in range(r.randint(0, 12)):
            near = list(base)
            for _ in range(r.randint(0, 3)):
                near[r.randrange(len(near))] = r.choice(words)
            out.append(" ".join(near))
    r.shuffle(out)
    return list(enumerate(out))


def result(spark, data):
    docs = spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id long, text string, component_id int")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(docs).collect()}


def test_against_brute_force(spark):
    data = rows()
    assert result(spark, data) == brute(data)


def test_large_groups_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "TASK_SHINGLES", 300)
    monkeypatch.setattr(N, "REGION", 3)
    data = rows()
    assert result(spark, data) == brute(data)


def test_odd_tables(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d")] * 2 + [(5, "a b c d")] * 2, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in N.near_duplicates(docs).collect()), key=repr)
    assert [g[2] for g in got] == [True] * 4 and N.kept_documents(docs).count() == 4


def brute_stage(rows):
    """Documents that five-word shingles and a similarity of 0.8 leave."""
    sets = {}
    for i, text in rows:
        words = text.encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_pipeline_stage_takes_five_words_and_four_fifths(spark):
    r = random.Random(8)
    prose = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    texts = ["", "one two three four", "One  two three four"]
    for _ in range(30):
        base = prose(r.randint(150, 300))
        n = len(base)
        texts.append(" ".join(base))
        # a header or footer: Jaccard 0.78 to 0.86
        more = prose(int(n * r.uniform(0.17, 0.28)))
        texts.append(" ".join(more + base if r.random() < 0.5 else base + more))
        # scattered edits: 0.76 to 0.84 over five words, 0.85 and more over three
        near = list(base)
        for at in r.sample(range(0, n, 6), round(n * r.uniform(0.018, 0.027))):
            near[at] = prose(1)[0]
        texts.append(" ".join(near))
    r.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == brute_stage(rows)
    assert got != {x["doc_id"] for x in N.kept_documents(docs).collect()}


def pairs_of_whole_table(rows, rule):
    """All pairs of different texts that the rule links, by common shingles from an inverted list."""
    sets, lists = {}, {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(words[k : k + rule.size]) for k in range(max(1, len(words) - rule.size + 1))) if words else frozenset()
        for x in sets[i]:
            lists.setdefault(x, []).append(i)
    out = []
    for i, own in sets.items():
        common = {}
        for x in own:
            for j in lists[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        out += [(j, i) for j, c in common.items() if 100 * c >= rule.share * (len(own) + len(sets[j]) - c)]
    return out


@pytest.mark.parametrize("rule", [N.OP3, N.STAGE])
def test_every_link_of_the_whole_table(spark, rule):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    pairs = pairs_of_whole_table([tuple(r) for r in docs.collect()], rule)
    found = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs, rule).collect()}
    assert len(pairs) > 100 and all(found[a] == found[b] for a, b in pairs)
    up = {i: i for i in found}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert all(find(i) == c for i, c in found.items())
