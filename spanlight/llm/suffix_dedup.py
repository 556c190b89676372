"""Removal of long byte strings that occur more than once, by a logarithmic family of suffix arrays.

Documents come in batches. A batch's suffix array holds its sampled suffixes (see ``suffix_windows``: at least one of them
starts in every window of 200 bytes), sorted by their first eight bytes and then by the fingerprint of their first 64, equal
ones as one entry with their number. ``SuffixIndex.add`` merge-scans it against the levels that exist, which finds
all prefixes that occur twice or more, and enters it as a level of size 1; levels of equal size merge to one of twice the
size, so n batches leave at most log2(n) + 1 levels and an entry is rewritten as often.

An exact check follows on the text around matches. All windows with one anchor form a run. Runs with equal contexts (all
bytes of their windows) repeat as a whole. What is left, runs at the edge of a match, are compared window by window
with the distinct contexts of the same suffix: as text cut from the documents, dealt out by suffix, or as fingerprints
summed in Spark where a suffix has more than ``HOT`` contexts, so that no task holds an unbounded group.

Defined results: a null text is empty; texts under 200 bytes lose nothing; windows never cross documents, whatever the
order of rows; rows equal in doc_id and text are documents of their own (each loses what the other repeats); an
empty table gives an empty result; added columns replace clashing ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import suffix_windows as windows
from .frames import Stage, blocks, plus, string_bytes, table, text_or_empty

WINDOW = windows.WINDOW
#: Batches that a whole table is added in.
BATCHES = 4
#: Contexts of one suffix that a task compares as text.
HOT = 1 << 10
SUFFIX = ("head", "key")
ADDED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class SuffixIndex:
    """The family of levels; each is a table of (head, key, n), sorted within its partitions."""

    def __init__(self, stage: Stage):
        self.stage, self.levels, self.batches = stage, [], 0

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Enters a batch of (head, key) rows and returns the suffixes of it that occur more than once so far."""
        self.batches += 1
        fresh = suffixes.groupBy(*SUFFIX).agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("fresh"))
        size, absorbed = 1, []
        while self.levels and self.levels[-1][0] == size:
            absorbed.append(self.levels.pop())
            size *= 2
        if absorbed:
            both = fresh
            for _, _, level in absorbed:
                both = both.unionByName(level.select(*SUFFIX, "n", F.lit(False).alias("fresh")))
            fresh = both.groupBy(*SUFFIX).agg(F.sum("n").alias("n"), F.max("fresh").alias("fresh"))
        name = f"level-{self.batches}"
        level = self.stage.write(fresh.sortWithinPartitions(*SUFFIX), name)
        self.stage.drop(*[old for _, old, _ in absorbed])
        found = level.where("fresh and n > 1").select(*SUFFIX)
        for _, _, other in self.levels:
            found = found.unionByName(level.where("fresh").select(*SUFFIX).join(other, list(SUFFIX), "left_semi"))
        self.levels.append((size, name, level))
        return self.stage.write(found, f"matches-{self.batches}")


def _rows(batch: pa.RecordBatch, keep: tuple[str, ...], make):
    """make(data, offsets) -> arrays with ``value``, for blocks of the batch's text, with the columns ``keep`` of the values' rows."""
    data, offsets = string_bytes(batch.column("text"))
    for i, j in blocks(offsets):
        found = make(data, offsets[i : j + 1])
        at = pa.array(found.pop("value") + i)
        yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in keep] + [pa.array(v) for v in found.values()], names=[*keep, *found])


def sampled_suffixes(docs: DataFrame) -> DataFrame:
    """docs with doc_id, text -> a row for each run of windows with one anchor: doc_id, print (of the text), first, last,
    key, head, context."""
    source = docs.select("doc_id", F.xxhash64("text").alias("print"), "text")

    def make(data, offsets):
        found = windows.runs(data, offsets)
        return found | {k: found[k].astype(np.int32) for k in ("first", "last")}

    def run(batches):
        for batch in batches:
            yield from _rows(batch, ("doc_id", "print"), make)

    schema = plus(source.select("doc_id", "print").schema, first="int", last="int", key="long", head="long", context="long")
    return source.mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, stage: Stage, batches: int = BATCHES) -> DataFrame:
    """docs with doc_id, text (no nulls) -> doc_id, print, first, last: ranges of starts of windows that occur more than once."""
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    suffixes = stage.write(sampled_suffixes(docs).select("*", batch), "suffixes", by="batch")
    index = SuffixIndex(stage)
    matches = [index.add(suffixes.where(F.col("batch") == b).select(*SUFFIX)) for b in range(batches)]
    repeated = matches[0]
    for m in matches[1:]:
        repeated = repeated.unionByName(m)
    repeated = stage.write(repeated.distinct(), "repeated")
    runs = stage.write(suffixes.drop("batch").join(repeated, list(SUFFIX), "left_semi"), "runs")
    stage.drop("suffixes", "repeated", *[f"matches-{i + 1}" for i in range(batches)], *[name for _, name, _ in index.levels])

    of_context = [*SUFFIX, "context"]
    contexts = stage.write(runs.groupBy(*of_context).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("print", "doc_id", "first", "last")).alias("at")), "contexts")
    settled = runs.join(contexts.where("n > 1").select(*of_context), of_context, "left_semi").select("doc_id", "print", "first", "last")
    mixed = contexts.groupBy(*SUFFIX).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select(*SUFFIX, "m")
    edges = contexts.join(mixed, list(SUFFIX)).select("at.*", F.struct("at.first", "at.last", "key", "head", "n", "m").alias("run")).groupBy("doc_id", "print").agg(F.collect_list("run").alias("runs"))
    pieces = stage.write(cut_pieces(docs, edges), "pieces")
    cool = pieces.where(F.col("m") <= HOT).drop("m")
    found = compared_pieces(cool.repartition(*SUFFIX).sortWithinPartitions(*SUFFIX)).unionByName(summed_windows(pieces.where(F.col("m") > HOT).drop("m")))
    return settled.unionByName(found)


def cut_pieces(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """The bytes of runs, cut from their documents."""
    source = with_runs(docs.select("doc_id", "text"), edges, "inner")
    schema = plus(source.select("doc_id", "print").schema, piece="binary", first="int", key="long", head="long", n="long", m="long")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data, offsets = string_bytes(part.column("text"))
                lists = part.column("runs")
                flat, counts = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(part.num_rows), counts)
                first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
                raw, base = memoryview(data), offsets[of]
                cut = [bytes(raw[a:b]) for a, b in zip((base + first).tolist(), (base + last + WINDOW).tolist())]
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), part.column("print").take(rows), pa.array(cut, pa.binary())] + [flat.field(k) for k in ("first", "key", "head", "n", "m")], schema=target(part))

    def target(part):
        return pa.schema([("doc_id", part.schema.field("doc_id").type), ("print", pa.int64()), ("piece", pa.binary()), ("first", pa.int32()), ("key", pa.int64()), ("head", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])

    return source.mapInArrow(run, schema)


def with_runs(docs: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """docs joined to the lists of their runs; the lists are the hashed side, texts are only streamed."""
    r = runs.select(F.col("doc_id").alias("_of"), F.col("print").alias("_print"), "runs").hint("shuffle_hash")
    joined = docs.withColumn("print", F.xxhash64("text")).join(r, F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("print") == F.col("_print")), how)
    return joined.drop("_of", "_print")


def piece_windows(pieces: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the piece and fingerprint (of bytes and suffix) of all windows of the pieces."""
    data, offsets = string_bytes(pieces.column("piece").combine_chunks())
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    _, window = windows.fingerprints(data)
    counts = np.diff(offsets) - WINDOW + 1
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    key = pieces.column("key").to_numpy().view(np.uint64)
    return row, place, windows._join(window[offsets[:-1][row] + place], key[row])


def ranges(pieces: pa.Table, row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Consecutive windows of a piece as ranges of starts in their document."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(row)) - 1 if len(starts) else starts
    first = pieces.column("first").to_numpy()[row[starts]]
    of = pa.array(row[starts])
    take = lambda k: pieces.column(k).combine_chunks().take(of)
    return pa.RecordBatch.from_arrays([take("doc_id"), take("print"), pa.array((first + place[starts]).astype(np.int32)), pa.array((first + place[stops]).astype(np.int32))], names=["doc_id", "print", "first", "last"])


def compared_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces, sorted by suffix -> ranges of the windows of lone contexts that another context of the suffix shares."""

    def whole_groups(batches):
        """Tables of about a million bytes that end where a suffix ends."""
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                key = part.column("key").to_numpy()
                if size > 1 << 20 and (cuts := np.flatnonzero(key[1:] != key[:-1])).size:
                    cut = int(cuts[0]) + 1
                    yield pa.Table.from_batches([*held, part.slice(0, cut)])
                    held, size, part = [], 0, part.slice(cut)
                held.append(part)
                size += part.nbytes
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        for group in whole_groups(batches):
            row, place, window = piece_windows(group)
            n = group.column("n").to_numpy()[row]
            order = np.argsort(window, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = window[order[1:]] != window[order[:-1]]
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(n[order], starts)
            twice = np.zeros(len(order), bool)
            twice[order] = np.repeat(sums > 1, np.diff(np.append(starts, len(order))))
            hit = np.flatnonzero(twice & (n == 1))
            yield ranges(group, row[hit], place[hit])

    schema = plus(pieces.select("doc_id", "print", "first").schema, last="int")
    return pieces.mapInArrow(run, schema)


def summed_windows(pieces: DataFrame) -> DataFrame:
    """``compared_pieces`` for suffixes with very many contexts: a row for each window, counted with partial sums."""
    schema = plus(pieces.select("doc_id", "print", "first").schema, last="int", key="long", window="long", n="long")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = pa.Table.from_batches([batch.slice(at, 2048)])
                row, place, window = piece_windows(part)
                start = pa.array((part.column("first").to_numpy()[row] + place).astype(np.int32))
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks().take(of), part.column("print").combine_chunks().take(of), start, start, part.column("key").combine_chunks().take(of), pa.array(window.view(np.int64)), part.column("n").combine_chunks().take(of)], names=schema.names)

    each = pieces.mapInArrow(run, schema)
    twice = each.groupBy("key", "window").agg(F.sum("n").alias("sum")).where("sum > 1").select("key", "window")
    return each.where("n = 1").join(twice, ["key", "window"], "left_semi").select("doc_id", "print", "first", "last")


def covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a window that starts in one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + WINDOW, -1)
    return np.cumsum(edge[:n]) > 0


def deduplicated(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs with doc_id, text -> the same rows, text without what repeats (an incomplete code point at a cut goes too), and the columns ``ADDED``."""
    stage = Stage(docs.sparkSession, "suffix")
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    columns = [c for c in docs.columns if c.lower() not in added]
    plain = docs.withColumn("text", text_or_empty())
    found = repeated_windows(plain.select("doc_id", "text"), stage, batches)
    lists = stage.write(found.groupBy("doc_id", "print").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "ranges")
    stage.drop("runs", "contexts", "pieces")
    extra = [F.col(c).alias(f"_c{i}") for i, c in enumerate(columns) if c not in ("doc_id", "text")]
    source = with_runs(plain.select("doc_id", "text", *extra), lists, "left").drop("print")
    names = ["doc_id", "text", *[f"_c{i}" for i, c in enumerate(columns) if c not in ("doc_id", "text")]]
    schema = plus(source.select(*names).schema, n_bytes="long", n_removed="long", n_spans="long", kept_sha256="string")

    def run(batches_):
        for batch in batches_:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data, offsets = string_bytes(part.column("text"))
                lists_ = part.column("runs")
                texts, totals, removed, spans, digests = [], [], [], [], []
                for i in range(part.num_rows):
                    raw = data[offsets[i] : offsets[i + 1]]
                    runs = lists_[i].values
                    if runs is None or not len(runs):
                        kept, gone, n_spans = raw.tobytes(), 0, 0
                    else:
                        out = covered(len(raw), runs.field("first").to_numpy(), runs.field("last").to_numpy())
                        kept, gone = raw[~out].tobytes(), int(out.sum())
                        n_spans = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                    texts.append(kept.decode("utf-8", "ignore"))
                    totals.append(len(raw))
                    removed.append(gone)
                    spans.append(n_spans)
                    digests.append(hashlib.sha256(kept).hexdigest())
                arrays = [part.column("doc_id"), pa.array(texts), *[part.column(k) for k in names[2:]], *[pa.array(x, pa.int64()) for x in (totals, removed, spans)], pa.array(digests)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *added])

    out = source.select(*names, "runs").mapInArrow(run, schema)
    back = {f"_c{i}": c for i, c in enumerate(columns)}
    return out.select(*[F.col(next((k for k, v in back.items() if v == c and k in names), c)).alias(c) for c in columns], *added)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def trimmed_documents(docs: DataFrame) -> DataFrame:
    """docs without what repeats, with the columns of docs; n_chars, if there, is the new length."""
    out = deduplicated(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
