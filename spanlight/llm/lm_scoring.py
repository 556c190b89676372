"""Stupid-backoff scores of documents, by joining their n-grams to count tables that are partitioned by hash.

A document is scored under the counts of its own corpus, itself included, unless another ``corpus`` is given. S(w | h) = c(h w) / c(h) where
c(h w) >= ``least``, else ``BACKOFF`` times S(w | h without its first word); for single words c(w) / N, where a word that the corpus lacks counts once. With
``least`` = 1 and the own corpus every n-gram is known, so only a document's first words have a shorter history; with another corpus, unknown n-grams back off.

Texts are split into words once and written as blocks of word fingerprints. A row of an exploded n-gram relation is
(bucket, block, keys, n): a block's distinct n-grams of one hash bucket with their number in it, packed, so a frequent n-gram comes once a block at most. For
each order the relation is dealt out by bucket, a bucket's task sums the counts, and joins them back to the rows of
its blocks; the counts of all orders then meet their block, where scores are summed per document. The number of buckets grows with the corpus, so a task holds
about ``BUCKET`` n-grams at any size. N-grams are told apart by 48 bits beside their bucket: with n of them in a bucket, a false match has odds of n / 2 ** 48.

Defined results: words are bytes split at ASCII white space, A-Z lower-cased; a null or empty text has no tokens and null scores;
equal texts score alike; repeated rows are kept (and counted as often); an empty table gives an empty result, an empty corpus scores as N = 1; added
columns replace clashing ones. A very long text is a block of its own: about 40 bytes of memory a word in the task that holds it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .frames import Stage, blocks, string_bytes, table, text_or_empty

ORDER, BACKOFF, LEAST = 3, 0.4, 1
#: Bytes of text in a block, and n-grams in a bucket, about.
BLOCK, BUCKET = 4 << 20, 2_000_000
_M, _N = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KEY = 6


class Words:
    """Fingerprints of words; remembers words up to a bound."""

    def __init__(self, most: int = 400_000):
        self.known, self.most = {}, most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def tokenised(docs: DataFrame, scored: bool, counted: bool) -> DataFrame:
    """docs with doc_id, text -> block, scored, counted, doc_ids, sizes (words of each), words (fingerprints, 8 bytes each); a row a block."""
    source = docs.select("doc_id", text_or_empty().alias("text"))

    def run(batches):
        words_of, at = Words(), TaskContext.get().partitionId() << 31 | (0 if scored else 1 << 30)
        for batch in batches:
            column = batch.column("text")
            _, offsets = string_bytes(column)
            for i, j in blocks(offsets, BLOCK):
                split = [t.encode().lower().split() for t in column.slice(i, j - i).to_pylist()]
                prints = words_of([w for words in split for w in words])
                distinct, place = np.unique(prints, return_inverse=True)
                rows = [[at], [scored], [counted], [batch.column("doc_id").slice(i, j - i).to_pylist()], [list(map(len, split))], [len(prints)], [distinct.tobytes()], [place.astype(np.int32).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds(batch))], names=schema.names)
                at += 1

    def kinds(batch):
        return [pa.int64(), pa.bool_(), pa.bool_(), pa.list_(batch.schema.field("doc_id").type), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]

    schema = T.StructType().add("block", "long").add("scored", "boolean").add("counted", "boolean").add("doc_ids", T.ArrayType(source.schema["doc_id"].dataType)).add("sizes", T.ArrayType(T.IntegerType())).add("n_words", "long").add("distinct", "binary").add("place", "binary")
    return source.mapInArrow(run, schema)


def words_in(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a block's words, and each one's place in its document."""
    words = np.frombuffer(row["distinct"], np.uint64)[np.frombuffer(row["place"], np.int32)]
    sizes = np.array(row["sizes"], np.int64)
    return words, np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def ngrams(words: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and fingerprints of the n-grams of one order that lie within a document."""
    ends = np.flatnonzero(place >= order - 1)
    out = words[ends - (order - 1)]
    for i in range(order - 2, -1, -1):
        out = out * _M + words[ends - i]
        out ^= out >> np.uint64(31)
        out *= _N
        out ^= out >> np.uint64(29)
    return ends, out


def packed(numbers: np.ndarray) -> bytes:
    """In 1, 2, 4 or 8 bytes each, by the largest."""
    most = int(numbers.max(initial=0))
    return numbers.astype(next(t for t in ("u1", "u2", "u4", "u8") if most < 1 << 8 * int(t[1]))).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def exploded(texts: DataFrame, order: int, bits: int) -> DataFrame:
    """The n-grams of one order: bucket, block, keys, n, a row for each bucket of 2 ** bits that a block has n-grams in."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = np.unique(ngrams(*words_in(row), order)[1], return_counts=True)
                if not row["counted"]:
                    n = np.zeros_like(n)
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                short = ((keys << np.uint64(bits)) >> np.uint64(64 - 8 * _KEY)).view(np.uint8).reshape(-1, 8)[:, :_KEY]
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]))
                arrays = [pa.array(bucket[starts]), pa.array([row["block"]] * len(cuts), pa.int64()), pa.array([short[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([packed(n[a:b]) for a, b in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "block", "keys", "n"])

    return texts.select("block", "counted", "sizes", "distinct", "place").mapInArrow(run, "bucket long, block long, keys binary, n binary")


def counted(grams: DataFrame, order: int) -> DataFrame:
    """Rows of ``exploded`` -> order, bucket, block, counts: what the corpus holds of each row's n-grams, in their order."""

    def join(rows: pa.Table) -> pa.Table:
        raw, sizes = rows.column("keys").to_pylist(), []
        sizes = [len(x) // _KEY for x in raw]
        keys = np.zeros((sum(sizes), 8), np.uint8)
        keys[:, :_KEY] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, _KEY)
        n = np.concatenate([unpacked(x, m) for x, m in zip(rows.column("n").to_pylist(), sizes)])
        keys = keys.reshape(-1).view(np.uint64)
        by_key = np.argsort(keys, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], np.diff(keys[by_key]) > 0)))
        found = np.empty(len(keys), np.int64)
        found[by_key] = np.repeat(np.add.reduceat(n[by_key], new), np.diff(np.append(new, len(keys))))
        edges = np.cumsum([0, *sizes])
        counts = [packed(found[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.table({"bucket": rows.column("bucket"), "block": rows.column("block"), "counts": pa.array(counts, pa.binary())})

    return grams.groupBy("bucket").applyInArrow(join, "bucket long, block long, counts binary").select(F.lit(order).alias("order"), "bucket", "block", "counts")


def counts_at(words: np.ndarray, place: np.ndarray, order: int, rows: list[tuple[int, bytes]], bits: int) -> np.ndarray:
    """The corpus' count of the n-gram that ends at each word, 0 where none does."""
    ends, keys = ngrams(words, place, order)
    distinct, at = np.unique(keys, return_inverse=True)
    bucket = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
    sizes = np.diff(np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(distinct)))
    found = [unpacked(raw, n) for (_, raw), n in zip(sorted(rows), sizes.tolist(), strict=True)]
    out = np.zeros(len(words), np.int64)
    if found:
        out[ends] = np.concatenate(found)[at]
    return out


def log_scores(counts: list[np.ndarray], place: np.ndarray, total: int, least: int) -> np.ndarray:
    """counts: of the n-grams of order 1, 2, ... that end at each word -> the logarithm of each word's score."""
    back, logs = math.log(BACKOFF), [np.log(np.maximum(c, 1)) for c in counts]
    score = logs[0] - math.log(max(total, 1))
    for k in range(1, len(counts)):
        history = np.concatenate(([0.0], logs[k - 1][:-1]))
        score = np.where(place < k, score, np.where(counts[k] >= least, logs[k] - history, score + back))
    return score


def scores(docs: DataFrame, order: int = ORDER, least: int = LEAST, corpus: DataFrame | None = None) -> DataFrame:
    """docs with doc_id, text -> doc_id, n_tokens, log_score (natural logarithm, null without tokens), per_token; one row a document."""
    stage, own = Stage(docs.sparkSession, "lm"), corpus is None
    texts = tokenised(docs, True, own)
    if not own:
        texts = texts.unionByName(tokenised(corpus.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text"), False, True))
    texts = stage.write(texts, "texts")
    words = texts.agg(F.sum("n_words"), F.sum(F.when(F.col("counted"), F.col("n_words")))).first()
    total, bits = words[1] or 0, max(0, math.ceil(math.log2(max(1, (words[0] or 0) / BUCKET))))
    tables = [stage.write(counted(exploded(texts, k, bits), k), f"counts-{k}") for k in range(1, order + 1)]
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType().add("doc_id", kind).add("n_tokens", "long").add("log_score", "double").add("per_token", "double")

    def score(block: pa.Table, counts: pa.Table) -> pa.Table:
        kinds = [block.schema.field("doc_ids").type.value_type, pa.int64(), pa.float64(), pa.float64()]
        if not block.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=schema.names)
        row = block.to_pylist()[0]
        (words, place), rows = words_in(row), [[] for _ in range(order)]
        for k, bucket, raw in zip(*(counts.column(c).to_pylist() for c in ("order", "bucket", "counts"))):
            rows[k - 1].append((bucket, raw))
        value = log_scores([counts_at(words, place, k + 1, rows[k], bits) for k in range(order)], place, total, least)
        sizes = np.array(row["sizes"], np.int64)
        sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), value, len(sizes)).astype(float)
        empty = sizes == 0
        return pa.table([pa.array(row["doc_ids"], kinds[0]), pa.array(sizes), pa.array(sums, mask=empty), pa.array(sums / np.maximum(sizes, 1), mask=empty)], names=schema.names)

    return texts.where("scored").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, schema)


def _rounded(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_tokens", F.round("log_score", 3).alias("log_score"), F.round("per_token", 6).alias("per_token"))


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order 3, with every n-gram that the corpus holds."""
    return _rounded(scores(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_turns_under_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` under the counts of all ``documents``: what they lack backs off."""
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    return _rounded(scores(turns, corpus=table(spark, sf_dir, "documents"))).select("doc_id.*", "n_tokens", "log_score", "per_token")


#: Every n-gram of a document is one of the corpus, so nothing backs off but at a document's start.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS raw FROM documents),
w AS (SELECT r, doc_id, list_transform(raw, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM d),
t AS (SELECT r, unnest(ws) AS b, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT r, i, lag(b, 2) OVER (PARTITION BY r ORDER BY i) AS a2, lag(b) OVER (PARTITION BY r ORDER BY i) AS a1, b FROM t),
n AS (SELECT count(*) AS n FROM t),
u AS (SELECT b AS w1, count(*) AS c FROM t GROUP BY b),
p AS (SELECT a1 AS w1, b AS w2, count(*) AS c FROM g WHERE i >= 1 GROUP BY 1, 2),
q AS (SELECT a2 AS w1, a1 AS w2, b AS w3, count(*) AS c FROM g WHERE i >= 2 GROUP BY 1, 2, 3),
s AS (
  SELECT g.r, CASE WHEN i >= 2 THEN ln(q.c) - ln(pa.c) WHEN i = 1 THEN ln(p.c) - ln(ua.c) ELSE ln(u.c) - ln(n.n) END AS v
  FROM g CROSS JOIN n JOIN u ON u.w1 = g.b LEFT JOIN u ua ON ua.w1 = g.a1 LEFT JOIN p ON p.w1 = g.a1 AND p.w2 = g.b
  LEFT JOIN p pa ON pa.w1 = g.a2 AND pa.w2 = g.a1 LEFT JOIN q ON q.w1 = g.a2 AND q.w2 = g.a1 AND q.w3 = g.b),
x AS (SELECT r, sum(v) AS v FROM s GROUP BY r)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, round(x.v, 3) AS log_score, round(x.v / len(ws), 6) AS per_token
FROM w LEFT JOIN x ON x.r = w.r
"""

OP5_TURNS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS raw FROM documents),
e AS (SELECT row_number() OVER () AS r, conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS raw FROM conversations),
t AS (SELECT r, true AS own, translate(unnest(raw), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b, unnest(range(len(raw))) AS i FROM d
      UNION ALL SELECT r, false, translate(unnest(raw), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), unnest(range(len(raw))) FROM e),
g AS (SELECT r, own, i, lag(b, 2) OVER o AS a2, lag(b) OVER o AS a1, b FROM t WINDOW o AS (PARTITION BY own, r ORDER BY i)),
n AS (SELECT count(*) AS n FROM g WHERE own),
u AS (SELECT b AS w1, count(*) AS c FROM g WHERE own GROUP BY 1),
p AS (SELECT a1 AS w1, b AS w2, count(*) AS c FROM g WHERE own AND i >= 1 GROUP BY 1, 2),
q AS (SELECT a2 AS w1, a1 AS w2, b AS w3, count(*) AS c FROM g WHERE own AND i >= 2 GROUP BY 1, 2, 3),
s AS (
  SELECT g.r, CASE WHEN q.c > 0 THEN ln(q.c) - ln(pa.c) WHEN p.c > 0 THEN ln(p.c) - ln(ua.c) ELSE ln(coalesce(u.c, 1)) - ln(n.n) END
         + ln(0.4) * (CASE WHEN q.c > 0 THEN 0 WHEN p.c > 0 THEN least(i, 2) - 1 ELSE least(i, 2) END) AS v
  FROM g CROSS JOIN n LEFT JOIN u ON u.w1 = g.b LEFT JOIN u ua ON ua.w1 = g.a1 LEFT JOIN p ON p.w1 = g.a1 AND p.w2 = g.b
  LEFT JOIN p pa ON pa.w1 = g.a2 AND pa.w2 = g.a1 LEFT JOIN q ON q.w1 = g.a2 AND q.w2 = g.a1 AND q.w3 = g.b WHERE NOT own),
x AS (SELECT r, sum(v) AS v FROM s GROUP BY r)
SELECT conv_id, turn, CAST(len(raw) AS BIGINT) AS n_tokens, round(x.v, 3) AS log_score, round(x.v / len(raw), 6) AS per_token
FROM e LEFT JOIN x ON x.r = e.r
"""
