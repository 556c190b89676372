"""The pipeline's stages on a small corpus, each against a plain version of what it is for, on what the stage before it kept."""

from collections import Counter

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken

from spanlight.llm import byte_bpe, quality

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, out[-1], SF).write.parquet(f"{at}/{i}")
        out.append(spark.read.parquet(f"{at}/{i}"))
    return [x.collect() for x in out]


def words(text):
    return (text or "").encode().split()


def test_columns_stay_until_tokens(stages):
    names = [set(rows[0].asDict()) for rows in stages]
    assert all(n == names[0] for n in names[:-1]) and {"ids", "n_tokens"} <= names[-1]


def test_quality_keeps_what_no_rule_rejects(spark, stages):
    before, after = stages[0], {r["doc_id"] for r in stages[1]}
    cuts = quality.cutoffs(quality.measured(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet"))
    for r in before:
        w = words(r["text"])
        grams = Counter(zip(w, w[1:], w[2:]))
        inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        if failed or not cuts:
            assert (r["doc_id"] in after) == (not failed)


def test_near_duplicates_leave_one_of_each_group(stages):
    rows = {r["doc_id"]: r["text"] for r in stages[1]}
    sets = {i: frozenset(tuple(w[k : k + 5]) for w in [(t or "").encode().lower().split()] for k in range(max(1, len(w) - 4)) if w) for i, t in rows.items()}
    up = {i: i for i in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in stages[2]} == {i for i in ids if find(i) == i or not sets[i]}


def test_repeated_passages_go(stages):
    raws = {r["doc_id"]: (r["text"] or "").encode() for r in stages[2]}
    counts = Counter(raw[i : i + 200] for raw in raws.values() for i in range(len(raw) - 199))
    want = {}
    for doc, raw in raws.items():
        gone = set()
        for i in range(len(raw) - 199):
            if counts[raw[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        want[doc] = bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")
    assert {r["doc_id"]: r["text"] for r in stages[3]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3])


def test_mix_comes_near_its_targets(stages):
    sizes, weight = {}, {}
    for r in stages[3]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    for i, source in enumerate(sorted(sizes)):
        weight[source] = (3, 1, 2)[i % 3]
    target, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while open_:
        full = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else left * weight[s] / sum(weight[x] for x in open_)
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    copies = Counter(r["doc_id"] for r in stages[4])
    texts = {r["doc_id"]: r for r in stages[3]}
    taken = Counter()
    for doc, n in copies.items():
        assert n <= 2
        taken[texts[doc]["source"]] += n * len(words(texts[doc]["text"]))
    longest = max(len(words(r["text"])) for r in stages[3])
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] + longest for s in sizes)
    assert {r["text"] for r in stages[4]} <= {r["text"] for r in stages[3]}


def test_tokens_of_each_text(stages):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks_of(P.path(byte_bpe.RANKS)), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert len(stages[5]) == len(stages[4]) and Counter(r["doc_id"] for r in stages[5]) == Counter(r["doc_id"] for r in stages[4])
    for r in stages[5]:
        assert r["ids"] == enc.encode_ordinary(texts[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"])
