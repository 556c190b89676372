import hashlib
from collections import Counter

import public_tokenizers as P
import regex
import tiktoken
from pyspark.sql import functions as F

from spanlight.llm import byte_bpe

PATH = P.path(byte_bpe.RANKS)
TEXTS = ["", None, "Hello world's best  of\n\n times", "thentherre  eauxçà élan ÜBER", "x" * 3000, "\x1c\x1d a b c\u0085d", "日本語 1234५६", "a" * 5 + "<|endoftext|>", " \t \n", "é" * 900]


ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})


def tokens(text):
    return ENCODING.encode_ordinary(text or "")


def test_encode_as_tiktoken_and_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_tokens string")
    out = byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN, with_ids=True), PATH).collect()
    assert len(out) == 2 * len(TEXTS)
    for r in out:
        ids = tokens(TEXTS[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        raw = (TEXTS[r["doc_id"]] or "").encode()
        assert bytes(r["decoded"]) == raw and r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()


def test_empty_table(spark):
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def test_higher_order_functions_fold_the_same_merges(spark):
    words = sorted({w for t in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(5).toPandas()["text"] for w in t.split()})[:200] + ["", "é", "\n\n"]
    got = byte_bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), byte_bpe.ranks_of(PATH)).collect()
    enc = byte_bpe.ranks_of(PATH)
    assert {r["word"]: r["ids"] for r in got} == {w: [enc[p] for p in byte_bpe.fold(w.encode(), enc)] for w in words}


def test_distinct_words_of_a_whole_table_natively(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(20).union(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter(w for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect() for w in regex.findall(P.PATTERN, r["text"] or ""))
    got = byte_bpe.op9_distinct_words(spark, str(tmp_path)).collect()
    assert {r["word"]: r["n"] for r in got} == dict(want) and len(got) == len(want)
    for r in got:
        ids = tokens(r["word"])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["word"].encode()).hexdigest()
