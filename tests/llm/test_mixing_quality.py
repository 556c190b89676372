import pytest
from pyspark.sql import functions as F

from spanlight.llm import mixing, quality


def test_targets_stop_at_twice_the_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got["c"] == 20 and abs(sum(got.values()) - 1.5 * 1520) < 1e-6 and got[None] == 1000


def test_mix_keeps_rows_and_bounds(spark):
    docs = spark.createDataFrame([(1, "w " * 30, "a", 7), (1, "w " * 30, "a", 8), (2, None, "b", 9), (None, "x y", None, 1), (4, "", None, 2)], "doc_id long, text string, source string, target long")
    out = mixing.mix(docs).collect()
    assert len(out) == 5 and all(r["taken"] <= 2 * r["size"] for r in out) and all(0 <= r["position"] <= 1 for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_taken_words_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("aim")).collect():
        assert abs(r["t"] - r["aim"]) <= 1


def brute_repeats(words):
    from collections import Counter

    c = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i in range(len(words) - 2):
        if c[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return len(inside)


@pytest.mark.parametrize("text", ["", "a", "a b c", "a a a a", "a b c d a b c", "x a b c y a b c z q", "a b " * 50])
def test_repeated_words(text):
    assert quality.repeated_words(text.encode().split()) == brute_repeats(text.split())


def test_counts():
    assert quality.counts_of("Ab#  c\nAb#  c\n\n \né!\x85") == (5, 11, 2, 1, 0, 3, 2, 1)
    assert quality.counts_of(None) == (0,) * 8


def test_tightest_cutoff_is_certified_and_useful():
    import numpy as np

    hist = np.zeros((2, 102), int)
    hist[1, 0], hist[1, 20] = 3000, 5
    hist[0, 30] = 100
    assert quality.tightest(hist, 0.01, 0.0025) == 290
    hist[1, 0] = 100
    assert quality.tightest(hist, 0.01, 0.0025) is None


def test_rules_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " ".join(map(str, range(80))), "en"), (3, "a " * 90, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    counts = quality.measured(docs)
    out = quality.judged(counts, quality.cutoffs(counts, labels)).orderBy("n_words").collect()
    assert [r["kept"] for r in out] == [False, False, True, False]
    assert quality.kept_documents(docs, labels).count() == 1
    assert quality.measured(docs.limit(0)).count() == 0


def test_labels_that_certify_cutoffs_and_the_same_by_sql(spark, tmp_path):
    """Enough labels that cutoffs hold, in one of two languages; bad texts shout, some good ones a little."""
    import random

    import compare
    from spanlight.llm import quality

    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(900)]
    docs, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        words = r.sample(vocabulary, r.randint(52, 70))
        if bad:
            words = [w + "!" * (i % 3) for w in words]
        docs.append((i, " ".join(words) + ("\n" + words[0].upper() if i % 7 == 0 else ""), "xx" if i < 1300 else None))
        labels.append((i, 0 if bad else 1, 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op4_quality_rules(spark, str(tmp_path)).toPandas()
    want = compare.duck(str(tmp_path)).sql(quality.OP4_SQL).df()
    assert compare.rows(got) == compare.rows(want)
    cut = got[~got["base_failed"] & ~got["kept"]]["doc_id"]
    assert len(cut) > 100 and all(i % 5 == 0 and i < 1300 for i in cut)


def test_kept_documents_keep_their_own_columns(spark):
    from spanlight.llm import quality

    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", "mine", 7), (2, "short", "en", "mine", 8), (3, None, None, "mine", 9)], "doc_id long, text string, lang string, kept string, n_words long")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    (row,) = quality.kept_documents(docs, labels).collect()
    assert row.asDict() == {"doc_id": 1, "text": text, "lang": "en", "kept": "mine", "n_words": 7}
    assert quality.kept_documents(docs.limit(0), labels).count() == 0
