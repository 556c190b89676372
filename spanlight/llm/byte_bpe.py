"""Byte-level BPE: encoding by ranked merges of bytes, decoding by concatenating the pieces of ids.

Two forms of the merge fold stand here. ``encode_words`` folds the merges with Spark's higher-order functions over the
byte arrays of distinct words, against a literal rank map; ``op9_distinct_words`` does so for all words of a corpus, split and counted natively. That takes
several times the budget (README), so ``encode`` serves whole documents: a task splits texts into
matches of the pattern and folds each distinct word once, keeping what it has seen in a bounded cache.

Both take a word that is a piece itself without folding; merges would end at the same piece, as every piece of the vocabulary can be reached by them.

Defined results: a null or empty text has no tokens (its digests are those of no bytes); special tokens are plain text;
equal texts have equal ids; an empty table gives an empty result; added columns replace clashing ones.
"""

from __future__ import annotations

import base64
import hashlib
import json
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import Stage, map_texts, table

RANKS = "byte_bpe_50k.tiktoken"
#: Distinct words that a task remembers at most; then it starts anew.
CACHE_WORDS = 400_000
SLOTS = 1 << 16
NATIVE_BYTES = 40
ADDED = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (x.split() for x in lines if x.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Pieces of a word: the adjacent pair of the lowest rank is merged, the leftmost of equals first, until none has a rank."""
    if len(word) > 400:
        return fold_long([word[i : i + 1] for i in range(len(word))], ranks)
    if word in ranks:
        return [word]
    get, none, edges = ranks.get, len(ranks), list(range(len(word) + 1))
    scores = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while scores and (best := min(scores)) < none:
        i = scores.index(best)
        del scores[i], edges[i + 1]
        if i:
            scores[i - 1] = get(word[edges[i - 1] : edges[i + 1]], none)
        if i < len(scores):
            scores[i] = get(word[edges[i] : edges[i + 2]], none)
    return [word[a:b] for a, b in zip(edges, edges[1:])]


def fold_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """``fold`` with a heap and linked places, for words of thousands of bytes."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get(a + b)) is not None]
    heapq.heapify(heap)
    live: list[bytes | None] = list(parts)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if live[i] != a or j >= n or live[j] != b:
            continue
        live[i], live[j] = a + b, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (r := ranks.get(live[left] + live[right])) is not None:
                heapq.heappush(heap, (r, left, live[left], live[right]))
    return [x for x in live if x is not None]


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """docs with text -> also n_tokens, the digests of ids and of the bytes that the ids decode to, and ids if asked for."""

    def make():
        import regex

        split, ranks = regex.compile(pattern).findall, ranks_of(path)
        pieces = {rank: piece for piece, rank in ranks.items()}
        #: Of the words that the task remembers: ids in decimals, what they decode to, and the ids.
        known: dict[str, str] = {}
        decoded_of: dict[str, bytes] = {}
        ids_of: dict[str, list[int]] = {}

        def add(word: str) -> None:
            own = [ranks[p] for p in fold(word.encode(), ranks)]
            known[word], decoded_of[word] = " ".join(map(str, own)), b"".join([pieces[i] for i in own])
            if with_ids:
                ids_of[word] = own

        def work(texts):
            counts, ids_digest, decoded_digest, ids = [], [], [], []
            for text in texts:
                if len(known) > CACHE_WORDS:
                    known.clear()
                    decoded_of.clear()
                    ids_of.clear()
                words = split(text or "")
                for word in set(words).difference(known):
                    add(word)
                written = " ".join(map(known.__getitem__, words))
                counts.append(written.count(" ") + 1 if words else 0)
                ids_digest.append(hashlib.sha256(written.encode()).hexdigest())
                decoded_digest.append(hashlib.sha256(b"".join(map(decoded_of.__getitem__, words))).hexdigest())
                if with_ids:
                    ids.append(list(chain.from_iterable(map(ids_of.__getitem__, words))))
            out = [pa.array(counts, pa.int64()), pa.array(ids_digest), pa.array(decoded_digest)]
            return out + [pa.array(ids, pa.list_(pa.int32()))] * with_ids

        return work

    return map_texts(docs, make, ADDED + ", ids array<int>" * with_ids)


def decode(ids: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """Rows with ids array<int> -> also decoded binary: the pieces of a literal table, concatenated in hex."""
    by_rank = sorted((rank, piece) for piece, rank in ranks_of(path).items())
    table_of = F.split(F.lit(" ".join(piece.hex() for _, piece in by_rank)), " ")
    return ids.withColumn("decoded", F.unhex(F.array_join(F.transform(column, lambda i: F.element_at(table_of, i + 1)), "")))


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: an array of hash slots, each with its few pieces, so a look-up needs no scan of the map."""
    slots: list[list[dict]] = [[] for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        slots[xxhash.xxh64_intdigest(piece, 42) % SLOTS].append({"p": base64.b64encode(piece).decode(), "r": rank})
    return F.from_json(F.lit(json.dumps(slots)), "array<array<struct<p:binary,r:int>>>")


def encode_words(words: DataFrame, ranks: dict[bytes, int], column: str = "word") -> DataFrame:
    """Distinct words -> also ids array<int>: higher-order functions fold the ranked merges over each word's byte array."""
    literal, none = rank_map(ranks), F.lit(1 << 30)

    def rank(piece: Column) -> Column:
        slot = F.element_at(literal, (F.pmod(F.xxhash64(piece), F.lit(SLOTS)) + 1).cast("int"))
        return F.coalesce(F.try_element_at(F.filter(slot, lambda e: e["p"] == piece), F.lit(1))["r"], none)

    def merge(parts: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))))
        def at_best(found: Column) -> Column:
            best = F.array_min(found)
            i = F.array_position(found, best).cast("int")
            joined = F.concat(F.slice(parts, F.lit(1), i - 1), F.array(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))), F.slice(parts, i + 2, F.size(parts)))
            return F.when(best < none, joined).otherwise(parts)
        return F.when(F.size(parts) < 2, parts).otherwise(F.element_at(F.transform(F.array(pairs), at_best), 1))

    raw = F.encode(F.col(column), "UTF-8")
    n = F.length(raw)
    single = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(raw, i, F.lit(1)))).otherwise(F.array().cast("array<binary>"))
    whole = rank(raw)
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), single, lambda parts, _: merge(parts))
    return words.withColumn("ids", F.when(whole < none, F.array(whole)).otherwise(F.transform(folded, rank)))


def distinct_words(docs: DataFrame, pattern: str) -> DataFrame:
    """docs with text -> word, n: the matches of the pattern, split with Unicode classes and counted with partial sums."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?U)" + pattern), F.lit(0))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def folded_words(words: DataFrame, path: str) -> DataFrame:
    """words with word, n -> also ids, by ``fold``."""

    def run(batches):
        ranks = ranks_of(path)
        for batch in batches:
            ids = [[ranks[p] for p in fold(w.encode(), ranks)] for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, ids array<int>")


def op9_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of all documents: how often each comes, its tokens, and what they decode to. Words of over ``NATIVE_BYTES`` bytes, whose native
    fold would take time by the cube of their length, are folded in Python."""
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    words = distinct_words(table(spark, sf_dir, "documents"), public_tokenizers.PATTERN)
    long = F.octet_length("word") > NATIVE_BYTES
    stage = Stage(spark, "words")
    words = stage.write(words.repartition(4 * spark.sparkContext.defaultParallelism), "counted")
    # written, so that the fold isn't repeated for each column made of it
    encoded = stage.write(encode_words(words.where(~long), ranks_of(path)).unionByName(folded_words(words.where(long), path)), "encoded")
    out = decode(encoded, path)
    return out.select("word", "n", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("text")
