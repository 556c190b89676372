"""Language identification by unigram models of pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. For each language of the training rows piece probabilities are fitted by expectation
maximisation on word counts; the probability of a word is the sum over all its segmentations into pieces, by the forward
algorithm. A text's score is the posterior of its best language under the product over its words and the languages' shares of
training rows.

The fit uses a sample of about ``SAMPLE`` training documents a language (chosen by a hash of doc_id) and all words of it, whole. Each
round maps the distinct words of a language to expected numbers of pieces, summed in units of 1 / ``UNITS`` so that their order doesn't
matter; every document is scored on its whole text.

Words are scored on their whole length: those of up to ``CACHE_LENGTH`` characters many at once over a trie of the pieces, longer ones each by itself with
scaled sums. The driver holds the training rows' languages with their numbers and the expected numbers of pieces: languages x vocabulary, so lang is taken to have few values.

Defined results: a text that is null or has no letter (Unicode category L) is ``und`` with score 0; so is every text where no training row exists; a null
language is never learned; documents with a null doc_id are neither held out nor trained on; equal texts score alike; of languages with equal posteriors the first in order is taken; repeated rows are
kept; words are lower-cased by Spark in the fit and by Python in the prediction, which differ in a few letters alone (İ), so a word with one may be cut unlike those that were fitted; an empty table gives an empty result; added columns replace clashing ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import Stage, map_texts, table

PIECES = "piece_bpe_32k.model"
SAMPLE, ROUNDS, SMOOTHING = 2000, 2, 0.1
UNITS = 1 << 32
#: Words that a task remembers, about; words up to CACHE_LENGTH characters are scored CHUNK at once, longer ones each by itself.
CACHE_WORDS, CACHE_LENGTH, CHUNK = 300_000, 30, 1 << 14
START = "▁"
UNKNOWN = 1e-7
LETTER = regex.compile(r"\p{L}")
UND = "und"
ADDED = "lang_pred string, score double"


def vocabulary(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return sorted({p.lower() for p in pieces})


class Trie:
    """Pieces by their characters, for many words at once: nodes are numbers, a hash table in numpy has the steps from node to node."""

    def __init__(self, pieces: list[str]):
        letters = sorted({c for x in pieces for c in x})
        self.classes = np.zeros(0x110000, np.int64)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        nodes, piece_of, steps = {"": 0}, [-1], []
        for at, piece in enumerate(pieces):
            for i in range(1, len(piece) + 1):
                if piece[:i] not in nodes:
                    nodes[piece[:i]] = len(piece_of)
                    steps.append(nodes[piece[: i - 1]] * self.width + int(self.classes[ord(piece[i - 1])]))
                    piece_of.append(-1)
            piece_of[nodes[piece]] = at
        self.piece_of = np.array(piece_of, np.int64)
        self.bits = max(4, (8 * len(steps)).bit_length())
        self.keys, self.nodes = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, -1, np.int64)
        keys, values = np.array(steps, np.int64), np.arange(1, len(steps) + 1)
        slot = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.nodes[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(np.arange(len(keys)), put)
            keys, values, slot = keys[left], values[left], slot[left] + 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes that the letters lead to, -1 where none."""
        keys = node * self.width + letter
        slot = self._slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.nodes[slot], -1)
        left = np.flatnonzero((found >= 0) & (found != keys))
        while len(left):
            slot[left] += 1
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.nodes[slot[left[hit]]]
            left = left[(found >= 0) & ~hit]
        return out

    def letters(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        """Classes of the words' characters, START first: a row for each place, a column for each word."""
        out = np.zeros((int(lengths.max(initial=0)), len(words)), np.int64)
        flat = self.classes[np.frombuffer((START + START.join(words)).encode("utf-32-le"), np.uint32)]
        starts = np.cumsum(lengths) - lengths
        out[np.arange(len(flat)) - np.repeat(starts, lengths), np.repeat(np.arange(len(words)), lengths)] = flat
        return out

    def edges(self, words: list[str]):
        """For words, longest first: (start, stop, words, pieces) in order of starts, each word once in each; a character that is no piece of its own has piece -1."""
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        letters = self.letters(words, lengths)
        for i in range(len(letters)):
            at = np.arange(int(np.searchsorted(-lengths, -i, "left")))
            node = self.step(np.zeros(len(at), np.int64), letters[i, at])
            yield i, i + 1, at, np.where(node >= 0, self.piece_of[node], -1)
            for j in range(i + 1, len(letters)):
                on = (node >= 0) & (lengths[at] > j)
                at = at[on]
                node = self.step(node[on], letters[j, at])
                at, node = at[node >= 0], node[node >= 0]
                if not len(at):
                    break
                piece = self.piece_of[node]
                whole = piece >= 0
                if whole.any():
                    yield i, j + 1, at[whole], piece[whole]


def longest_first(words: list[str]) -> np.ndarray:
    return np.argsort([-len(w) for w in words], kind="stable")


def many_scores(words: list[str], trie: Trie, probabilities: np.ndarray) -> np.ndarray:
    """``word_scores`` of many words of up to CACHE_LENGTH characters. probabilities: a row a piece, and one for an unknown character."""
    order = longest_first(words)
    longest = len(words[order[0]]) + 1 if len(words) else 0
    ahead = np.zeros((longest + 1, len(words), probabilities.shape[1]))
    ahead[0] = 1.0
    for i, j, at, piece in trie.edges([words[k] for k in order]):
        ahead[j, at] += ahead[i, at] * probabilities[piece]
    ends = np.array([len(words[k]) + 1 for k in order], np.int64)
    out = np.empty((len(words), probabilities.shape[1]))
    out[order] = np.log(np.maximum(ahead[ends, np.arange(len(words))], 1e-300))
    return out


def many_expected(words: list[str], counts: np.ndarray, trie: Trie, probabilities: np.ndarray) -> np.ndarray:
    """The expected number of each piece in all words (of up to CACHE_LENGTH characters), in units of 1 / UNITS. probabilities: of the pieces, and of an unknown character."""
    order, out = longest_first(words), np.zeros(len(probabilities), np.int64)
    if not len(words):
        return out[:-1]
    ends, n = np.array([len(words[k]) + 1 for k in order], np.int64), counts[order]
    ahead = np.zeros((ends[0] + 1, len(words)))
    ahead[0] = 1.0
    edges = []
    for i, j, at, piece in trie.edges([words[k] for k in order]):
        ahead[j, at] += ahead[i, at] * probabilities[piece]
        edges.append((i, j, at, piece))
    share = np.zeros_like(ahead)
    share[ends, np.arange(len(words))] = 1.0
    for i, j, at, piece in reversed(edges):
        part = share[j, at] * (ahead[i, at] * probabilities[piece] / ahead[j, at])
        share[i, at] += part
        np.add.at(out, piece, np.rint(part * n[at] * UNITS).astype(np.int64))
    return out[:-1]


def expected_pieces(word: str, p: Prefixed) -> dict[str, float]:
    """The expected number of each piece in one word's segmentations, of any length. The sums over beginnings are scaled; a place's share of all
    segmentations is dealt from the word's end to the places before it."""
    n, nothing, get = len(word), (), p.get
    ahead, level, found, now = [1.0] + [0.0] * n, [0] * (n + 1), [[] for _ in range(n + 1)], 0
    for i in range(n):
        if ahead[i] < 1e-150:
            now += 1
            for j in range(i, min(n, i + p.longest) + 1):  # no piece has reached further yet
                ahead[j] *= 1e140
        level[i], before = now, ahead[i]
        for j in range(i + 1, n + 1):
            q = get(word[i:j], nothing)
            if q:
                ahead[j] += before * q
                found[j].append(i)
            else:
                if j == i + 1:
                    ahead[j] += before * UNKNOWN
                    found[j].append(i)
                if q is nothing:
                    break
    level[n] = now
    share, out = [0.0] * n + [1.0], {}
    for j in range(n, 0, -1):
        if share[j]:
            for i in found[j]:
                piece = word[i:j]
                q = get(piece, nothing)
                part = ahead[i] / ahead[j] * (q or UNKNOWN)
                if level[i] != level[j]:
                    part *= 1e140 ** (level[j] - level[i])
                part *= share[j]
                share[i] += part
                if q:
                    out[piece] = out.get(piece, 0.0) + part
    return out


def fitted(words: DataFrame, langs: list[str], pieces: list[str]) -> list[dict[str, float]]:
    """words with lang, word, count -> piece probabilities of each language."""
    p = np.full((len(langs), len(pieces)), 1.0 / len(pieces))
    for _ in range(ROUNDS):

        def run(batches, p=p):
            models, place = {lang: Prefixed(dict(zip(pieces, row.tolist()))) for lang, row in zip(langs, p)}, {x: i for i, x in enumerate(pieces)}
            sums, trie = {lang: np.zeros(len(pieces), np.int64) for lang in langs}, Trie(pieces)
            for batch in batches:
                of_lang = {}
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                    if len(word) <= CACHE_LENGTH:
                        of_lang.setdefault(lang, []).append((word, n))
                        continue
                    for piece, expected in expected_pieces(START + word, models[lang]).items():
                        sums[lang][place[piece]] += round(n * expected * UNITS)
                for lang, rows in of_lang.items():
                    with_unknown = np.append(p[langs.index(lang)], UNKNOWN)
                    sums[lang] += many_expected([w for w, _ in rows], np.array([n for _, n in rows], np.int64), trie, with_unknown)
            for at, lang in enumerate(langs):
                some = np.flatnonzero(sums[lang])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), at, np.int64)), pa.array(some), pa.array(sums[lang][some])], names=["lang", "piece", "n"])

        counts = np.full(p.shape, SMOOTHING)
        for r in words.select("lang", "word", "count").mapInArrow(run, "lang long, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
            counts[r["lang"], r["piece"]] += r["n"] / UNITS
        p = counts / counts.sum(1, keepdims=True)
    return [dict(zip(pieces, row.tolist())) for row in p]


def train(docs: DataFrame, path: str, sample: int = SAMPLE) -> dict:
    """docs with doc_id, text, lang -> {"langs", "prior" (log), "pieces": {piece: probabilities by language}}."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(totals)
    if not langs:
        return {"langs": [], "prior": [], "pieces": {}}
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / totals[lang]))).otherwise(share)
    luck = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counted = rows.where(luck < share).select("lang", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''").groupBy("lang", "word").count()
    stage = Stage(docs.sparkSession, "language")
    counted = stage.write(counted.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "lang", "word"), "words")
    pieces = vocabulary(path)
    models = fitted(counted, langs, pieces)
    stage.drop("words")
    everything = sum(totals.values())
    return {"langs": langs, "prior": [math.log(totals[x] / everything) for x in langs], "pieces": {x: tuple(m[x] for m in models) for x in pieces}}


class Prefixed(dict):
    """Pieces with their probabilities, and None for what only begins a piece, so a look-up that finds nothing ends the search from its place."""

    def __init__(self, pieces: dict[str, tuple]):
        super().__init__()
        self.longest = max(map(len, pieces), default=1)
        for x in pieces:
            for i in range(1, len(x)):
                self.setdefault(x[:i], None)
        self.update(pieces)


def word_scores(word: str, pieces: dict[str, tuple], n_langs: int) -> list[float]:
    """Logarithms of the word's probability in each language, over all segmentations."""
    if not isinstance(pieces, Prefixed):
        pieces = Prefixed(pieces)
    word = START + word
    n, span, scale = len(word), range(n_langs), [0.0] * n_langs
    ahead: list = [[1.0] * n_langs] + [None] * n
    unknown, nothing, get = (UNKNOWN,) * n_langs, (), pieces.get
    for i in range(n):
        before = ahead[i]
        if min(before) < 1e-150:
            for k in span:
                if before[k] < 1e-150:
                    for j in range(i, min(n, i + pieces.longest) + 1):  # no piece has reached further yet
                        if ahead[j] is not None:
                            ahead[j][k] *= 1e140
                    scale[k] -= 140 * math.log(10)
        for j in range(i + 1, n + 1):
            q = get(word[i:j], nothing)
            if not q:
                if j == i + 1:
                    now = ahead[j]
                    ahead[j] = [b * u for b, u in zip(before, unknown)] if now is None else [a + b * u for a, b, u in zip(now, before, unknown)]
                if q is nothing:
                    break
                continue
            now = ahead[j]
            ahead[j] = [b * p for b, p in zip(before, q)] if now is None else [a + b * p for a, b, p in zip(now, before, q)]
    return [math.log(x) + s for x, s in zip(ahead[n], scale)]


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs with text -> also lang_pred and score."""
    langs, prior, pieces = model["langs"], np.array(model["prior"]), model["pieces"]

    def make():
        n, by_prefix = len(langs), Prefixed(pieces)
        trie, probabilities = Trie(list(pieces)), np.array([*pieces.values(), (UNKNOWN,) * n]) if n else np.zeros((1, 1))
        known: dict[bytes, int] = {}
        rows = np.zeros((1024, max(n, 1)))

        def learn(words: list[bytes]) -> None:
            nonlocal rows
            if len(known) > CACHE_WORDS:
                known.clear()
            new = list(set(words).difference(known))
            read = [w.decode() for w in new]
            first = len(known)
            if first + len(new) > len(rows):
                rows = np.concatenate([rows[:first], np.zeros((first + 2 * len(new), rows.shape[1]))])
            short = [i for i, w in enumerate(read) if len(w) <= CACHE_LENGTH]
            for at in range(0, len(short), CHUNK):
                some = short[at : at + CHUNK]
                rows[[first + i for i in some]] = many_scores([read[i] for i in some], trie, probabilities)
            for i, w in enumerate(read):
                if len(w) > CACHE_LENGTH:
                    rows[first + i] = word_scores(w, by_prefix, n)
            known.update(zip(new, range(first, first + len(new))))

        def work(texts):
            readable = np.array([t is not None and bool(langs) and LETTER.search(t) is not None for t in texts], bool)
            split = [t.lower().encode().split() if r else [] for t, r in zip(texts, readable)]
            words, sizes = [w for s in split for w in s], np.array([len(s) for s in split], np.int64)
            learn(words)
            names, scores = np.full(len(texts), UND, object), np.zeros(len(texts))
            if readable.any():
                own = rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
                total = prior + np.add.reduceat(own, (np.cumsum(sizes) - sizes)[readable], axis=0)
                best = total.argmax(1)
                names[readable] = [langs[k] for k in best]
                scores[readable] = 1.0 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0.0)).sum(1)
            return [pa.array(names.tolist(), pa.string()), pa.array(scores, pa.float64())]

        return work

    return map_texts(docs, make, ADDED)


def held_out():
    """Of a document: crc32 of its doc_id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()), public_tokenizers.path(PIECES))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
