"""Removal of words that repeat from earlier documents, by a De Bruijn graph of word windows.

A window of ``K`` consecutive words is an edge from the node of its first K - 1 words to the node of its last K - 1; the two
fingerprints of 64 bits together identify it. Only edges that start in two documents or more belong to the graph.

* Windows are found by their minimizer, the ``GRAM`` words with the least fingerprint in them: consecutive windows with one
  minimizer are one row (a run), a fifth of the number of words. Runs whose minimizer stands in one document alone go.
* Runs with equal words (a context) are one from here on, so copies cost a row each, not a row a window. A context that its
  minimizer alone has is a chain of edges that no other text enters; other (mixed) contexts are taken edge by edge.
* Edges are summed: the earliest document and place of each, and whether a later document has it too.
* The graph is compacted: where one repeated chain or edge alone enters a node and one alone leaves it, and the second follows
  the first in the document that both come from first, they are joined; what is joined from end to end is a path.
* Each document's repeated windows are laid along the paths; a span of consecutive windows on one path is verified word by word
  against the path's text at its source before its words go.

Defined results: a null text has no words; documents of fewer than K words lose nothing; windows never cross documents. Rows
with one doc_id are one document: none of them is earlier than the other, but each loses what a smaller doc_id has. A null
doc_id is neither earlier nor later than any: such rows lose nothing and cause no loss. Rows equal in doc_id and text get equal
results. An empty table gives an empty result; added columns replace clashing ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from . import words
from .frames import Stage, blocks, plus, string_bytes, table, text_or_empty

K, GRAM = 13, 4
#: Words of a source that are verified together.
CHUNK = 64
_GRAMS = K - GRAM + 1
_U = np.uint64
_PLACE = _U((1 << 31) - 1)
_NUMBERS = words.table(1009)
ADDED = ("n_words", "n_removed", "kept_sha256")


def least_grams(gram: np.ndarray) -> np.ndarray:
    """The place of the least of the next _GRAMS grams, the leftmost of equals, at every gram where as many follow."""
    m, n = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64), 1
    while 2 * n <= _GRAMS:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    if n < _GRAMS:
        m = np.minimum(m[: -(_GRAMS - n)], m[_GRAMS - n :])
    return (m & _PLACE).astype(np.int64)


def nodes(g: dict[int, np.ndarray]) -> np.ndarray:
    """Fingerprints of K - 1 words."""
    n = len(g[1]) - K + 2
    return words.pair(g[8][:n], g[4][8 : 8 + n])


def runs(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Maximal runs of windows with one minimizer: value, first and last window (by words of the value), key (of the minimizer)
    and context (of all words of the run and the minimizer's place in it)."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts, ends, value = words.spans(data, offsets)
    if len(starts) < K:
        return dict.fromkeys(("value", "first", "last", "key", "context"), np.zeros(0, np.int64))
    g = words.grams(words.fingerprints(data, starts, ends, _NUMBERS), 8)
    node, n = nodes(g), len(starts) - K + 1
    window = words.pair(node[:n], g[1][K - 1 :])
    at = np.flatnonzero(value[:n] == value[K - 1 :])
    anchor = least_grams(g[GRAM])[at]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first, last = np.append(0, cut), np.append(cut, len(at)) - 1
    if not len(at):
        return dict.fromkeys(("value", "first", "last", "key", "context"), np.zeros(0, np.int64))
    anchor, first, last = anchor[first], at[first], at[last]
    shape = ((anchor - first).astype(np.uint64) << _U(32)) | (last - first).astype(np.uint64)
    context = words.pair(words.pair(window[first], window[last]), words.mixed(shape + _U(1)))
    of, base = value[first], np.searchsorted(value, np.arange(len(offsets)))
    return {"value": of, "first": first - base[of], "last": last - base[of], "key": g[GRAM][anchor].view(np.int64), "context": context.view(np.int64)}


def all_runs(docs: DataFrame, *fields: str) -> DataFrame:
    """docs with doc_id, text -> doc_id, print (of the text, if it is among the fields) and ``fields`` of all runs."""
    own = ["doc_id", *(["print"] if "print" in fields else [])]
    fields = [f for f in fields if f != "print"]
    source = docs.withColumn("print", F.xxhash64("text")).select(*own, "text")
    kinds = {"first": "int", "last": "int", "key": "long", "context": "long"}

    def run(batches):
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for i, j in blocks(offsets):
                found = runs(data, offsets[i : j + 1])
                of = pa.array(found["value"] + i)
                yield pa.RecordBatch.from_arrays([batch.column(k).take(of) for k in own] + [pa.array(found[k].astype(np.int32) if kinds[k] == "int" else found[k]) for k in fields], names=[*own, *fields])

    return source.mapInArrow(run, plus(source.select(*own).schema, **{k: kinds[k] for k in fields}))


def with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """docs joined to the lists of their text; the lists are the hashed side, texts are only streamed."""
    right = lists.withColumnsRenamed({"doc_id": "_of", "print": "_print"}).hint("shuffle_hash")
    joined = docs.withColumn("print", F.xxhash64("text")).join(right, F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("print") == F.col("_print")), how)
    return joined.drop("_of", "_print")


def chains_of(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """The edges of contexts, from the text that each is first in: u, v, doc_id, print, at (first window), count (of edges), key, context,
    place (in the context), most, mixed. A mixed context gives a row an edge, another one its edges as one chain."""
    lists = contexts.groupBy("doc_id", "print").agg(F.collect_set(F.struct("first", "last", "key", "context", "most", "mixed")).alias("runs"))
    source = with_lists(docs.select("doc_id", "text"), lists, "inner").select("doc_id", "print", "text", "runs")
    of_doc = source.schema["doc_id"].dataType
    kinds = {"u": T.LongType(), "v": T.LongType(), "doc_id": of_doc, "print": T.LongType(), "at": T.IntegerType(), "count": T.IntegerType(), "key": T.LongType(), "context": T.LongType(), "place": T.IntegerType(), "most": of_doc, "mixed": T.BooleanType()}

    def run(batches):
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for i, j in blocks(offsets):
                part, at_ = batch.slice(i, j - i), offsets[i : j + 1] - offsets[i]
                raw = data[offsets[i] : offsets[j]]
                starts, ends, value = words.spans(raw, at_)
                node = nodes(words.grams(words.fingerprints(raw, starts, ends, _NUMBERS), 8)).view(np.int64)
                base, lists_ = np.searchsorted(value, np.arange(j - i)), part.column("runs").flatten()
                of_row = np.repeat(np.arange(j - i), part.column("runs").value_lengths().to_numpy())
                first, last, mixed = (lists_.field(k).to_numpy(zero_copy_only=False) for k in ("first", "last", "mixed"))
                rows = np.where(mixed, last - first + 1, 1).astype(np.int64)
                of = np.repeat(np.arange(len(first)), rows)
                place = np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
                count, at = np.where(mixed, 1, last - first + 1)[of], first[of] + place
                here, same, take = base[of_row[of]] + at, pa.array(of_row[of]), pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[here]), pa.array(node[here + count]), part.column("doc_id").take(same), part.column("print").take(same), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), *[lists_.field(k).take(take) for k in ("key", "context")], pa.array(place.astype(np.int32)), *[lists_.field(k).take(take) for k in ("most", "mixed")]],
                    names=list(kinds),
                )

    return source.mapInArrow(run, T.StructType([T.StructField(k, v) for k, v in kinds.items()]))


def earliest(*columns: str) -> list:
    """Aggregates: the columns of a row of the smallest doc_id. All are taken at the same rows, as they share their order."""
    return [F.min("doc_id").alias("doc_id"), *[F.min_by(c, "doc_id").alias(c) for c in columns]]


def repeated_chains(chains: DataFrame) -> DataFrame:
    """What starts in two documents or more: u, v, count, the first place (from_doc, from_print, from_at), and key and context of whole contexts."""
    edges = chains.where("mixed").groupBy("u", "v").agg(*earliest("print", "at"), F.max("most").alias("most"), F.lit(1).alias("count")).withColumns({"key": F.lit(None).cast("long"), "context": F.lit(None).cast("long")})
    both = chains.where("not mixed").select("u", "v", "doc_id", "print", "at", "most", "count", "key", "context").unionByName(edges).where("doc_id < most")
    return both.select("u", "v", "count", F.col("doc_id").alias("from_doc"), F.col("print").alias("from_print"), F.col("at").alias("from_at"), "key", "context")


def compacted(graph: DataFrame) -> DataFrame:
    """The graph's chains with ``path``: the place at which the nonbranching path of the chain begins in its source."""
    place, after = ["from_doc", "from_print", "from_at"], F.col("from_at") + F.col("count")
    enters = graph.select(F.col("v").alias("node"), F.col("from_doc").alias("a_doc"), F.col("from_print").alias("a_print"), after.alias("a_end"))
    leaves = graph.select(F.col("u").alias("node"), *place)
    inner = enters.unionByName(leaves, allowMissingColumns=True).groupBy("node").agg(F.count("a_end").alias("i"), F.count("from_at").alias("o"), *[F.max(c).alias(c) for c in ("a_doc", "a_print", "a_end", *place)])
    follows = inner.where("i = 1 and o = 1 and a_doc = from_doc and a_print = from_print and a_end = from_at").select(*place, F.lit(True).alias("joined"))
    source = Window.partitionBy("from_doc", "from_print").orderBy("from_at")
    marked = graph.withColumn("joined", F.lit(None).cast("boolean")).unionByName(follows, allowMissingColumns=True).withColumn("joined", F.max("joined").over(source.rangeBetween(0, 0)))
    heads = F.when(F.col("joined").isNull(), F.col("from_at"))
    return marked.withColumn("path", F.max(heads).over(source)).where("u is not null").drop("joined")


def laid_out(found: DataFrame, chains: DataFrame, paths: DataFrame) -> DataFrame:
    """Runs of all documents laid along the paths -> doc_id, print, runs (first window, steps along paths)."""
    step = lambda place: F.struct(place.alias("place"), "count", "from_doc", "from_print", "path", (F.col("from_at") - F.col("path")).alias("along"))
    edges = chains.where("mixed").select("u", "v", "key", "context", "place", "most").join(paths.where("key is null").drop("key", "context"), ["u", "v"]).where("from_doc < most")
    contexts = edges.groupBy("key", "context").agg(F.collect_set(step(F.col("place"))).alias("steps"))
    contexts = contexts.unionByName(paths.where("key is not null").select("key", "context", F.array(step(F.lit(0))).alias("steps")))
    rows = found.select("doc_id", "print", "first", "key", "context").join(contexts, ["key", "context"]).withColumn("steps", F.expr("filter(steps, s -> s.from_doc < doc_id)")).where("size(steps) > 0")
    return rows.groupBy("doc_id", "print").agg(F.collect_set(F.struct("first", "steps")).alias("runs"))


def pieces_of(lists: DataFrame) -> DataFrame:
    """Consecutive windows of a document on one path are a span; spans are cut where a chunk of their source's words ends. A row a
    piece: doc_id, print, first and count (of the span's windows), at and n (of the piece's words), from_doc, from_print, chunk,
    skip (words of the chunk before the piece)."""
    of_doc, of_print = lists.schema["doc_id"].dataType, T.LongType()
    ints = ("first", "count", "at", "n")
    schema = T.StructType([T.StructField("doc_id", of_doc), T.StructField("print", of_print), *[T.StructField(k, T.IntegerType()) for k in ints], T.StructField("from_doc", of_doc), T.StructField("from_print", of_print), T.StructField("chunk", T.IntegerType()), T.StructField("skip", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists_ = part.column("runs")
                of_run = np.repeat(np.arange(part.num_rows), lists_.value_lengths().to_numpy())
                steps = lists_.flatten().field("steps")
                lengths = steps.value_lengths().to_numpy()
                row, first, s = np.repeat(of_run, lengths), np.repeat(lists_.flatten().field("first").to_numpy(), lengths), steps.flatten()
                place, size, path, along, prints = (s.field(k).to_numpy() for k in ("place", "count", "path", "along", "from_print"))
                doc = s.field("from_doc").dictionary_encode().indices.to_numpy()
                at = first + place
                order = np.lexsort((at, row))
                row, at, size, path, along, prints, doc = (x[order] for x in (row, at, size, path, along, prints, doc))
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + size[:-1]) | (doc[1:] != doc[:-1]) | (prints[1:] != prints[:-1]) | (path[1:] != path[:-1]) | (along[1:] != along[:-1] + size[:-1])
                span = np.flatnonzero(new)
                count = np.add.reduceat(size, span) if len(span) else size
                begin = path[span] + along[span]  # words of the source: begin <= word < stop
                stop = begin + count + K - 1
                each = (stop - 1) // CHUNK - begin // CHUNK + 1
                of = np.repeat(np.arange(len(span)), each)
                chunk = begin[of] // CHUNK + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
                low, high = np.maximum(begin[of], chunk * CHUNK), np.minimum(stop[of], (chunk + 1) * CHUNK)
                rows, source = pa.array(row[span][of]), pa.array(order[span][of])
                numbers = (at[span][of], count[of], at[span][of] + low - begin[of], high - low)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("print").take(rows), *[pa.array(x.astype(np.int32)) for x in numbers], s.field("from_doc").take(source), s.field("from_print").take(source), pa.array(chunk.astype(np.int32)), pa.array((low - chunk * CHUNK).astype(np.int32))],
                    names=schema.names,
                )

    return lists.mapInArrow(run, schema)


def chunk_texts(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The words of each chunk that a piece asks for: from_doc, from_print, chunk, words (joined by one space)."""
    wanted = pieces.select(F.col("from_doc").alias("doc_id"), F.col("from_print").alias("print"), "chunk").distinct()
    source = with_lists(docs.select("doc_id", "text"), wanted.groupBy("doc_id", "print").agg(F.collect_list("chunk").alias("chunks")), "inner").select("doc_id", "print", "text", "chunks")
    schema = T.StructType([T.StructField("from_doc", source.schema["doc_id"].dataType), T.StructField("from_print", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("words", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                data, offsets = string_bytes(part.column("text"))
                found = data[offsets[0] : offsets[1]].tobytes().split()
                chunks = part.column("chunks")[0].as_py()
                same = pa.array(np.zeros(len(chunks), np.int64))
                cut = [b" ".join(found[c * CHUNK : (c + 1) * CHUNK]) for c in chunks]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(same), part.column("print").take(same), pa.array(chunks, pa.int32()), pa.array(cut, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema).dropDuplicates(["from_doc", "from_print", "chunk"])


def removed_words(found: list[bytes], pieces: list[tuple]) -> np.ndarray:
    """Which words lie in a window of a span; windows with a word that its source doesn't have stay. pieces: (first, count, at, n, skip, words)."""
    out = np.zeros(len(found) + 1, np.int64)
    spans: dict[int, np.ndarray] = {}
    for first, count, at, n, skip, text in pieces:
        same = spans.get(first)
        if same is None:
            same = spans[first] = np.zeros(count + K - 1, bool)
        theirs, mine = text.split(b" ")[skip : skip + n], found[at : at + n]
        i = at - first
        same[i : i + n] = True if theirs == mine else [a == b for a, b in zip(theirs, mine)] + [False] * (n - min(len(theirs), len(mine)))
    for first, same in spans.items():
        if same.all():
            out[first] += 1
            out[first + len(same)] -= 1
        else:
            for at in (first + np.flatnonzero(np.convolve(same, np.ones(K, int), "valid") == K)).tolist():
                out[at] += 1
                out[at + K] -= 1
    return np.cumsum(out[:-1]) > 0


def deduplicated(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """docs with doc_id, text -> the same rows, text without what repeats from earlier documents (its words joined by one space; texts that
    lose nothing stay as they are; no text at all unless ``with_text``), and the columns ``ADDED``."""
    stage = Stage(docs.sparkSession, "debruijn")
    columns = [c for c in docs.columns if c.lower() not in ADDED]
    plain = docs.withColumn("text", text_or_empty())
    known = plain.select("doc_id", "text").where(F.col("doc_id").isNotNull())

    keys = all_runs(known, "key", "context").groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("context").alias("c"), F.max("context").alias("d")).where("a < b").select("key", F.expr("c <> d").alias("mixed"))
    keys = stage.write(keys, "keys")
    found = stage.write(all_runs(known, "print", "first", "last", "key", "context").join(keys.hint("shuffle_hash"), "key"), "runs")
    stage.drop("keys")
    contexts = stage.write(found.groupBy("key", "context", "mixed").agg(*earliest("print", "first", "last"), F.max("doc_id").alias("most")), "contexts")
    chains = stage.write(chains_of(known, contexts), "chains")
    stage.drop("contexts")
    graph = stage.write(repeated_chains(chains), "graph")
    paths = stage.write(compacted(graph), "paths")
    stage.drop("graph")
    laid = stage.write(laid_out(found, chains, paths), "laid")
    stage.drop("runs", "chains", "paths")
    pieces = stage.write(pieces_of(laid), "pieces")
    stage.drop("laid")
    chunks = stage.write(chunk_texts(known, pieces), "chunks")
    texts = pieces.join(chunks, ["from_doc", "from_print", "chunk"]).groupBy("doc_id", "print").agg(F.collect_list(F.struct("first", "count", "at", "n", "skip", "words")).alias("pieces"))
    texts = stage.write(texts, "texts")
    stage.drop("pieces", "chunks")
    return without(plain, texts, columns, with_text)


def without(docs: DataFrame, texts: DataFrame, columns: list[str], with_text: bool) -> DataFrame:
    """docs without the windows that pieces cover, as far as they hold the words of their source."""
    others = [c for c in columns if c not in ("doc_id", "text")]
    aliases = {c: f"_c{i}" for i, c in enumerate(others)}
    source = with_lists(docs.select("doc_id", "text", *[F.col(c).alias(k) for c, k in aliases.items()]), texts, "left")
    names = ["doc_id", *(["text"] if with_text else []), *aliases.values()]
    schema = plus(source.select(*names).schema, n_words="long", n_removed="long", kept_sha256="string")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                (data, offsets), lists = string_bytes(part.column("text")), part.column("pieces")
                rows, ends = lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))
                numbers = [rows.field(k).to_pylist() for k in ("first", "count", "at", "n", "skip")]
                texts_, totals, gone, digests = [], [], [], []
                for i in range(part.num_rows):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    kept = found = raw.split()
                    a, b = int(ends[i]), int(ends[i + 1])
                    if a < b:
                        out = removed_words(found, list(zip(*[v[a:b] for v in numbers], rows.field("words")[a:b].to_pylist())))
                        kept = [w for w, o in zip(found, out.tolist()) if not o]
                    joined = b" ".join(kept)
                    if with_text:
                        texts_.append((raw if len(kept) == len(found) else joined).decode())
                    totals.append(len(found))
                    gone.append(len(found) - len(kept))
                    digests.append(hashlib.sha256(joined).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *([pa.array(texts_, pa.string())] if with_text else []), *[part.column(k) for k in aliases.values()], pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests)], names=[*names, *ADDED])

    out = source.select("doc_id", "text", *aliases.values(), "pieces").mapInArrow(run, schema)
    return out.select(*[F.col(aliases.get(c, c)).alias(c) for c in columns if with_text or c != "text"], *ADDED)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
windows AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS win FROM starts),
least AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN least USING (win) WHERE least < doc_id),
gone AS (SELECT doc_id, list(i) AS gone FROM hit GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, len(coalesce(gone, [])) AS m, list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
