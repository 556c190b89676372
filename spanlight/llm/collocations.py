"""Phrases of two and three words that occur together more often than their words suggest, for each language.

Counting goes level by level, as a phrase is no more frequent than its parts: words, then pairs of frequent words, then triples
of frequent pairs. In a level, each task counts in a HAT-trie over word ids (``hat_trie``), which spills whole subtrees as
sorted runs while it is full. The runs are dealt out by prefix (the words but the last, and a sixteenth of the last words, so that
a common prefix is many partitions) and summed there: a row a phrase and run meets, never a row an occurrence.

Which words or pairs are frequent reaches the tasks as a Bloom filter of a fixed 8 MB. What it lets through by mistake only
costs work, as the sums decide; nothing that is frequent is held back.

A word's id is a fingerprint of 64 bits of language and word. Ids are checked for collisions over all distinct words, and
the next seed is taken if there is one, so counts are exact.

Defined results: a null text has no words; a null language is ``und``, together with rows of that value; equal rows all count.
An empty table, or no phrase that is frequent enough, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import words
from .frames import Stage, blocks, string_bytes, table
from .hat_trie import HatTrie

LEAST, TOP, SHARE = 10, 2000, 50
PIECE_ENDS = words.bytes_of([*b".,;:!?", *range(0x0A, 0x0E)])
BLANK = PIECE_ENDS | words.bytes_of(b" \t")
#: Bits of a filter, and places that an id sets.
BITS, PLACES = 1 << 26, 4
_BLOCK = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_U = np.uint64


def filter_places(ids: np.ndarray) -> list[np.ndarray]:
    """The bits of ids in a filter."""
    a, b = words.mixed(ids + _U(0x5BD1)), words.mixed(ids ^ _U(0xC6A4A7935BD1E995)) | _U(1)
    return [(a + _U(i) * b) & _U(BITS - 1) for i in range(PLACES)]


def filter_of(ids: DataFrame) -> np.ndarray:
    """A filter of the ids, an array of 64-bit words: partial ones a task, united in Spark."""

    def run(batches):
        bits = np.zeros(BITS >> 6, np.uint64)
        for batch in batches:
            for at in filter_places(batch.column(0).to_numpy().view(np.uint64)):
                np.bitwise_or.at(bits, at >> _U(6), _U(1) << (at & _U(63)))
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(bits[some].view(np.int64))], names=["at", "bits"])

    out = np.zeros(BITS >> 6, np.uint64)
    found = ids.mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def held(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for at in filter_places(ids):
        out &= (bits[at >> _U(6)] >> (at & _U(63))) & _U(1) > 0
    return out


def read_words(batch: pa.RecordBatch, numbers: np.ndarray):
    """Blocks of a batch with lang, text: bytes, starts, ends, value of each word, its id, and whether the next word stands in the same piece."""
    langs = batch.column("lang").dictionary_encode()
    data, offsets = string_bytes(langs.dictionary)
    own = np.zeros(len(langs.dictionary), np.uint64)
    for i in range(len(own)):
        raw = data[offsets[i] : offsets[i + 1]]
        own[i] = words.fingerprints(raw, np.array([0]), np.array([len(raw)]), numbers, np.zeros(256, bool))[0] if len(raw) else _U(7)
    own = own[langs.indices.to_numpy()]
    data, offsets = string_bytes(batch.column("text"))
    for i, j in blocks(offsets, _BLOCK):
        raw, at = _LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, value = words.spans(raw, at, BLANK)
        value += i
        ids = words.pair(own[value], words.fingerprints(raw, starts, ends, numbers, BLANK))
        piece = np.searchsorted(np.flatnonzero(PIECE_ENDS[raw]), starts)
        near = np.zeros(len(starts), bool)
        near[:-1] = (piece[1:] == piece[:-1]) & (value[1:] == value[:-1])
        yield raw, starts, ends, value, ids, near


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """docs with lang, text -> lang, word, id, n: all distinct words with their counts."""
    numbers = words.table(seed)

    def run(batches):
        for batch in batches:
            for raw, starts, ends, value, ids, _ in read_words(batch, numbers):
                found, first, n = np.unique(ids, return_index=True, return_counts=True)
                lengths = ends[first] - starts[first]
                ends_at = np.cumsum(lengths)
                cut = raw[np.repeat(starts[first] - ends_at + lengths, lengths) + np.arange(int(ends_at[-1]) if len(first) else 0)]
                text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(0, ends_at).astype(np.int64)), pa.py_buffer(cut)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(value[first])), text, pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "word", "id", "n"])

    rows = texts(docs).mapInArrow(run, "lang string, word string, id long, n long")
    return rows.groupBy("lang", "word").agg(F.max("id").alias("id"), F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, seed: int, length: int, frequent: DataFrame, least: int) -> DataFrame:
    """Phrases of ``length`` words whose parts of one word less are all in ``frequent`` (id), with at least ``least`` occurrences: w1, w2, ..., n."""
    names = [f"w{i + 1}" for i in range(length)]
    numbers, bits = words.table(seed), docs.sparkSession.sparkContext.broadcast(filter_of(frequent))

    def rows(entries):
        for ids, counts in entries:
            yield pa.RecordBatch.from_arrays([*[pa.array(c.view(np.int64)) for c in ids], pa.array(counts)], names=[*names, "n"])

    def run(batches):
        trie = HatTrie()
        for batch in batches:
            for _, _, _, _, ids, near in read_words(batch, numbers):
                if len(ids) < length:
                    continue
                part, n = (ids if length == 2 else words.pair(ids[:-1], ids[1:])), len(ids) - length + 1
                known = held(bits.value, part)
                good = known[:n] & known[1 : n + 1]
                for i in range(length - 1):
                    good &= near[i : i + n]
                at = np.flatnonzero(good)
                trie.put(np.stack([ids[at + i] for i in range(length)]))
                yield from rows(trie.spill())
        yield from rows(trie.spill(everything=True))

    runs = texts(docs).mapInArrow(run, ", ".join(f"{k} long" for k in [*names, "n"]))
    prefix = [*names[:-1], "part"]
    runs = runs.withColumn("part", F.col(names[-1]).bitwiseAND(F.lit(15))).repartition(*prefix)
    return runs.groupBy(*prefix, names[-1]).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(*names, "n")


def scored(cuts: list[tuple[str, str]]):
    """The least score over cuts with (l, r), ties to the first, as a struct score, k, l, r; in decimals of 38 digits."""
    wide = lambda c: f"CAST({c} AS DECIMAL(38,0))"
    return F.least(*[F.expr(f"struct((CAST(1000000 AS DECIMAL(38,0)) * a * a) div ({wide(l)} * {r}) AS score, {k} AS k, {l} AS l, {r} AS r)") for k, (l, r) in enumerate(cuts, 1)]) if len(cuts) > 1 else F.expr(f"struct((CAST(1000000 AS DECIMAL(38,0)) * a * a) div ({wide(cuts[0][0])} * {cuts[0][1]}) AS score, 1 AS k, {cuts[0][0]} AS l, {cuts[0][1]} AS r)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, seed: int = 1) -> DataFrame:
    """docs with lang, text -> lang, rank, phrase, a, l, r, n, score: the first ``top`` of each language."""
    stage = Stage(docs.sparkSession, "collocations")
    while True:
        everything = stage.write(word_counts(docs, seed), f"words-{seed}")
        if everything.groupBy("id").count().where("count > 1").isEmpty():
            break
        stage.drop(f"words-{seed}")
        seed += 1
    totals = stage.write(everything.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    known = stage.write(everything.where(F.col("n") >= least), "frequent")
    stage.drop(f"words-{seed}")
    pairs = stage.write(phrase_counts(docs, seed, 2, known.select("id"), least), "pairs")
    triples = stage.write(phrase_counts(docs, seed, 3, with_ids(pairs), least), "triples")

    def word(k: str, *more):
        return known.select(F.col("id").alias(k), F.col("word").alias(f"{k}_word"), F.col("n").alias(f"{k}_n"), *more)

    inside = triples.select("w1", "w2", "n").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "n")).groupBy("w1", "w2").agg(F.max("n").alias("longer"))
    two = pairs.withColumnRenamed("n", "a").join(inside, ["w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    two = two.join(word("w1", "lang"), "w1").join(word("w2"), "w2").select("lang", F.concat_ws(" ", "w1_word", "w2_word").alias("phrase"), "a", scored([("w1_n", "w2_n")]).alias("s"))
    three = triples.withColumnRenamed("n", "a").join(pairs.select("w1", "w2", F.col("n").alias("left_n")), ["w1", "w2"]).join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("right_n")), ["w2", "w3"])
    three = three.join(word("w1", "lang"), "w1").join(word("w2"), "w2").join(word("w3"), "w3").select("lang", F.concat_ws(" ", "w1_word", "w2_word", "w3_word").alias("phrase"), "a", scored([("w1_n", "right_n"), ("left_n", "w3_n")]).alias("s"))
    found = two.unionByName(three).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def with_ids(pairs: DataFrame) -> DataFrame:
    """The ids of pairs, as tasks compute them."""

    def run(batches):
        for batch in batches:
            left, right = (batch.column(k).to_numpy().view(np.uint64) for k in ("w1", "w2"))
            yield pa.RecordBatch.from_arrays([pa.array(words.pair(left, right).view(np.int64))], names=["id"])

    return pairs.select("w1", "w2").mapInArrow(run, "id long")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
lists AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM lists),
runs AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
f1 AS (SELECT lang, x, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS f FROM runs WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM runs WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
longer AS (SELECT lang, x, y, max(f) AS most FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT f2.lang, concat_ws(' ', f2.x, f2.y) AS phrase, f2.f AS a, 1 AS k, l.f AS l, r.f AS r FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 r ON r.lang = f2.lang AND r.x = f2.y
  LEFT JOIN longer g ON g.lang = f2.lang AND g.x = f2.x AND g.y = f2.y WHERE g.most IS NULL OR 100 * g.most < 50 * f2.f
  UNION ALL SELECT f3.lang, concat_ws(' ', f3.x, f3.y, f3.z), f3.f, 1, l.f, r.f FROM f3 JOIN f1 l ON l.lang = f3.lang AND l.x = f3.x JOIN f2 r ON r.lang = f3.lang AND r.x = f3.y AND r.y = f3.z
  UNION ALL SELECT f3.lang, concat_ws(' ', f3.x, f3.y, f3.z), f3.f, 2, l.f, r.f FROM f3 JOIN f2 l ON l.lang = f3.lang AND l.x = f3.x AND l.y = f3.y JOIN f1 r ON r.lang = f3.lang AND r.x = f3.z),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM scored JOIN n USING (lang) QUALIFY rank <= 2000
"""
