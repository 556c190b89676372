"""Near-duplicate documents by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

A ``Rule`` has the words of a shingle, the least Jaccard similarity of linked documents, and the trees and values that find them: ``OP3`` is the
rule of the query, ``STAGE`` of the pipeline's stage. A signature has three values a tree (48 and 16 in ``OP3``). Tree t orders signatures with the
values rotated left by 3 t, so the first three values of all trees are different ones. Documents with a common prefix of three values form a region of
their tree. How deep a region is looked into depends on its size: in one of up to ``REGION`` documents signatures are sorted, neighbours with the
longest common prefixes are tied first, and then whatever agrees in ``rule.agree`` values at least; a larger one is too common to tell documents apart
by signatures in one task, so its documents all become candidates of each other, tied to the least of them by partial sums and a join that Spark can split. Only as many candidate
pairs leave a task as span them.

Two documents with Jaccard similarity 0.85 share no region of ``OP3`` with probability (1 - 0.85 ** 3) ** 16 < 3e-7, and agree in too few values with
about 1e-6; at 0.8 these are (1 - 0.8 ** 3) ** 21 < 3e-7 and 8e-7 for ``STAGE``. All documents that candidates connect are then compared on full sets: in one task while their sets are up to ``TASK_SHINGLES``; beyond
that in blocks, first with the most typical document, and what that doesn't link with all blocks, so no task holds an unbounded group. In such a group the work grows with
its size times the number of documents that the typical one doesn't link.

Defined results: words are bytes split at ASCII white space with A-Z lower-cased; a text with no words has an empty set
and is linked with nothing; a text of fewer words than a shingle has one shingle, the whole; documents with equal sets are linked without
comparison; rows with the same doc_id are one document and share a component; rows with a null doc_id are linked with nothing, have a null
component and are kept; an empty table gives an empty result; added columns replace clashing ones; a very long text takes about 100 bytes of memory a word. Shingles are
compared as 64-bit fingerprints.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import components
from .frames import Stage, plus, table, text_or_empty

DEPTH = 3
REGION = 512
TASK_SHINGLES = 4_000_000
_M = np.uint64(0x9E3779B97F4A7C15)


class Rule(NamedTuple):
    """Words of a shingle, least share of common shingles (of a hundred), trees, and the least number of equal values of candidates."""

    size: int
    share: int
    trees: int
    agree: int

    @property
    def values(self) -> int:
        return DEPTH * self.trees


OP3, STAGE = Rule(3, 85, 16, 28), Rule(5, 80, 21, 34)


@lru_cache
def _hashes(values: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(77))
    xor = r.integers(0, 1 << 64, values, dtype=np.uint64, endpoint=False)[:, None]
    return xor, (r.integers(0, 1 << 64, values, dtype=np.uint64, endpoint=False) | np.uint64(1))[:, None]


class Shingler:
    """Sets of shingles of some words; remembers the fingerprints of words up to a bound."""

    def __init__(self, size: int, most: int = 400_000):
        self.size, self.known, self.most = size, {}, most

    def __call__(self, text: str | None) -> np.ndarray:
        size = self.size
        words = (text or "").encode().lower().split()
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        if len(h) < size:
            out = np.array([len(h)], np.uint64)
            for x in h:
                out = _mixed(out, x)
            return out
        out = h[: len(h) - size + 1]
        for i in range(1, size):
            out = _mixed(out, h[i : len(h) - size + 1 + i])
        return np.unique(out)


def _mixed(a, b):
    x = a * _M + b
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def signature(shingles: np.ndarray, values: int) -> np.ndarray:
    xor, mul = _hashes(values)
    out = np.full(values, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        out = np.minimum(out, (((shingles[None, at : at + 4096] ^ xor) * mul) >> np.uint64(32)).min(1))
    return out.astype(">u4")


def features(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, sign (its values, big-endian), print (16 bytes, of the set)."""
    source = docs.select("doc_id", "text")

    def run(batches):
        shingle = Shingler(rule.size)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s, rule.values).tobytes() for s in sets], pa.binary()), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "sign", "print"],
                )

    return source.mapInArrow(run, plus(source.select("doc_id").schema, n_shingles="long", sign="binary", print="binary"))


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def spanned(signs: np.ndarray, agree: int) -> list[tuple[int, int]]:
    """signs: of a region, in order. Candidate pairs that span what candidates connect: neighbours by their common prefixes, the longest first,
    then each document with those in order after it that aren't tied to it yet."""
    m, union, out = len(signs), Union(len(signs)), []
    same = signs[1:] == signs[:-1]
    near = np.flatnonzero(same.sum(1) >= agree)
    for i in near[np.argsort(-np.cumprod(same[near], axis=1).sum(1), kind="stable")].tolist():
        union.join(i, i + 1)
        out.append((i, i + 1))
    root = np.array([union.find(i) for i in range(m)])
    for i in range(m - 1):
        others = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if not len(others):
            continue
        for j in others[(signs[others] == signs[i]).sum(1) >= agree].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def groups(batches, key: str):
    """Tables of the rows of one key or several whole keys, from batches sorted by key."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            k = part.column(key)
            if held:
                same = k.to_numpy(zero_copy_only=False) == held[-1].column(key)[-1].as_py()
                stay = int(np.argmin(same)) if not same.all() else len(same)
                if stay < len(same) and size > 1 << 20:
                    yield pa.Table.from_batches([*held, part.slice(0, stay)]).combine_chunks()
                    held, size, part = [], 0, part.slice(stay)
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def segments(keys: np.ndarray):
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)])


def matrix(column, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def stars(node: np.ndarray, component: np.ndarray, u: list, v: list) -> None:
    """Adds an edge from each node to the least one of its component."""
    order = np.lexsort((node, component))
    new = np.ones(len(order), bool)
    new[1:] = component[order[1:]] != component[order[:-1]]
    least = node[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    other = node[order] != least
    u += node[order][other].tolist()
    v += least[other].tolist()


def candidates(nodes: DataFrame, stage: Stage, rule: Rule) -> DataFrame:
    """nodes with node, sign -> (u, v): nodes that candidates connect within a part of the forest, each with the least one of them."""
    tree = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.substring("sign", 4 * DEPTH * t + 1, 4 * DEPTH)).alias("region")) for t in range(rule.trees)])).alias("x")
    placed = nodes.select("node", tree).select("node", "x.*")
    shared = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head")).where("n > 1")
    alive = stage.write(placed.join(shared.hint("merge"), "region"), "alive")
    large = alive.where(F.col("n") > REGION).select(F.col("node").alias("u"), F.col("head").alias("v")).where("u <> v").distinct()
    order = F.concat(F.substring(F.col("sign"), 4 * DEPTH * F.col("t") + F.lit(1), F.lit(4 * rule.values)), F.substring(F.col("sign"), F.lit(1), 4 * DEPTH * F.col("t")))
    small = alive.where(F.col("n") <= REGION).join(nodes.select("node", "sign"), "node")
    forest = small.select("region", order.alias("order"), "node").repartition("region").sortWithinPartitions("region", "order", "node")

    def run(batches):
        for rows in groups(batches, "region"):
            region, node = rows.column("region").to_numpy(), rows.column("node").to_numpy()
            signs = matrix(rows.column("order"), rule.values, ">u4").astype(np.uint32)
            ids, place = np.unique(node, return_inverse=True)
            union = Union(len(ids))
            for a, b in segments(region):
                for i, j in spanned(signs[a:b], rule.agree):
                    union.join(int(place[a + i]), int(place[a + j]))
            u, v = [], []
            stars(ids, np.array([union.find(i) for i in range(len(ids))], np.int64), u, v)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return forest.mapInArrow(run, "u long, v long").unionByName(large)


def with_sets(docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """nodes -> also shingles (sorted fingerprints as bytes), made anew from the texts of their documents."""
    wanted = nodes.withColumnRenamed("node", "_node").hint("shuffle_hash")
    source = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("_node")).drop("doc_id")
    names = [c for c in source.columns if c != "text"]

    def run(batches):
        shingle = Shingler(rule.size)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle(t) for t in part.column("text").to_pylist()]
                own = pa.array([xxhash.xxh128_digest(s.tobytes()) == p for s, p in zip(sets, part.column("print").to_pylist())])
                out = pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "shingles"])
                yield out.filter(own)

    return source.mapInArrow(run, plus(source.select(*names).schema, shingles="binary")).withColumnRenamed("_node", "node")


def alike(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    both = len(a) + len(b)
    if 100 * min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    common = both - len(np.union1d(a, b))
    return 100 * common >= share * (both - common)


def linked(signs: np.ndarray, sets: list[np.ndarray], rule: Rule, asked: np.ndarray | None = None) -> np.ndarray:
    """The component of each document (the place of one of its members), by all links between the documents, or by those of
    the ``asked`` ones to all. Pairs that are already connected aren't compared; the most typical document goes first, so a group around one
    text takes about one comparison each. A document with many candidates is compared with all at once, by marks on its shingles."""
    m = len(sets)
    component = np.arange(m)
    rows = component if asked is None else np.flatnonzero(asked)
    if asked is None and m > 8:
        sample = signs[:: max(1, m // 256)]
        mode = []
        for c in sample.T:
            values, counts = np.unique(c, return_counts=True)
            mode.append(values[counts.argmax()])
        rows = np.argsort(-(signs == np.array(mode, np.uint32)).sum(1), kind="stable")
    sizes = np.array([len(s) for s in sets])
    places = marks = None
    for i in rows.tolist():
        near = np.flatnonzero(((signs == signs[i]).sum(1) >= rule.agree) & (component != component[i]))
        if not len(near):
            continue
        if len(near) <= 8:
            hits = [j for j in near.tolist() if alike(sets[i], sets[j], rule.share)]
        else:
            if places is None:
                places = np.unique(np.concatenate(sets), return_inverse=True)[1]
                marks, edges = np.zeros(int(places.max()) + 1, bool), np.concatenate(([0], np.cumsum(sizes)))
            own = places[edges[i] : edges[i + 1]]
            marks[own] = True
            common = np.add.reduceat(marks[places], edges[:-1], dtype=np.int64)
            marks[own] = False
            hits = near[100 * common[near] >= rule.share * (sizes[i] + sizes[near] - common[near])].tolist()
        for j in hits:
            if component[j] != component[i]:
                component[component == component[j]] = component[i]
    return component


def _links(sets: DataFrame, key: str, rule: Rule) -> DataFrame:
    """Rows with key, node, sign, shingles and asked (null: all) -> (u, v): each node with the least one that it is linked to within its key."""
    dealt = sets.select(key, "node", "asked", "sign", "shingles").repartition(key).sortWithinPartitions(key, "node")

    def run(batches):
        for rows in groups(batches, key):
            node, asked = rows.column("node").to_numpy(), rows.column("asked")
            signs = matrix(rows.column("sign"), rule.values, ">u4").astype(np.uint32)
            u, v = [], []
            for a, b in segments(rows.column(key).to_numpy()):
                shingles = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").slice(a, b - a).to_pylist()]
                some = asked.slice(a, b - a)
                of = linked(signs[a:b], shingles, rule, some.to_numpy(zero_copy_only=False).astype(bool) if some.null_count == 0 else None)
                stars(node[a:b], of, u, v)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def _large_groups(sets: DataFrame, stage: Stage, rule: Rule) -> DataFrame:
    """Links in groups whose sets exceed a task: blocks meet the group's most typical document, and what that doesn't link meets all blocks."""
    values = F.transform(F.sequence(F.lit(0), F.lit(rule.values - 1)), lambda i: F.struct(i.alias("i"), F.substring(F.col("sign"), 4 * i + 1, F.lit(4)).alias("value")))
    counts = sets.select("group", F.explode(values).alias("x")).groupBy("group", "x.i", "x.value").count()
    modes = counts.groupBy("group", "i").agg(F.max_by("value", F.struct("count", "value")).alias("value")).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("mode"))
    agreed = F.size(F.filter(F.col("mode"), lambda e: e["value"] == F.substring(F.col("sign"), 4 * e["i"] + 1, F.lit(4))))
    typical = sets.join(modes, "group").groupBy("group").agg(F.max_by("node", F.struct(agreed, "node")).alias("node"))
    n_blocks = F.ceil(F.col("total") / TASK_SHINGLES).cast("int")
    blocks = sets.withColumn("block", F.pmod(F.xxhash64("node"), n_blocks).cast("int"))
    to_all = F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block")
    columns = [F.xxhash64("group", "block").alias("key"), "node", "asked", "sign", "shingles"]
    heads = sets.join(typical, ["group", "node"], "left_semi").select("*", to_all).withColumn("asked", F.lit(True))
    first = stage.write(_links(blocks.join(typical, ["group", "node"], "left_anti").withColumn("asked", F.lit(False)).select(*columns).unionByName(heads.select(*columns)), "key", rule), "links-typical")
    done = first.select(F.col("u").alias("node")).union(first.select("v"))
    rest = sets.join(done, "node", "left_anti").withColumn("asked", F.lit(True)).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), n_blocks).cast("int"))
    chunks = rest.select("group", "chunk").distinct()
    columns[0] = F.xxhash64("group", "block", "chunk").alias("key")
    members = blocks.join(chunks, "group").withColumn("asked", F.lit(False))
    asked = rest.select("*", to_all)
    both = members.join(rest.select("group", "chunk", "node"), ["group", "chunk", "node"], "left_anti").select(*columns).unionByName(asked.select(*columns))
    return first.unionByName(_links(both, "key", rule))


def near_duplicates(docs: DataFrame, rule: Rule = OP3) -> DataFrame:
    """docs with doc_id (long), text -> doc_id, n_shingles, component_id, kept; one row a document."""
    stage = Stage(docs.sparkSession, "near")
    plain = docs.select("doc_id", text_or_empty().alias("text"))
    every = stage.write(features(plain, rule), "features")
    nodes = stage.write(every.where("n_shingles > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"), F.first("sign").alias("sign"), F.first("n_shingles").alias("n")), "nodes")
    near = components(stage.write(candidates(nodes, stage, rule), "candidates"), stage, "near")
    members = near.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(near.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct())
    members = stage.write(members.join(nodes, "node"), "members")
    totals = members.groupBy("group").agg(F.sum("n").alias("total"))
    sets = stage.write(with_sets(plain, members.join(totals, "group"), rule).withColumn("asked", F.lit(None).cast("boolean")), "sets")
    found = _links(sets.where(F.col("total") <= TASK_SHINGLES), "group", rule)
    large = sets.where(F.col("total") > TASK_SHINGLES)
    if not large.isEmpty():
        found = found.unionByName(components(stage.write(_large_groups(large, stage, rule), "links"), stage, "linked"))
    found = stage.write(found.distinct(), "found")
    stage.drop("sets", "members", "candidates", "alive")
    classes = nodes.join(found, nodes["node"] == found["u"], "left").select("print", F.coalesce("v", "node").alias("class"))
    out = every.join(classes, "print", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("class", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame, rule: Rule = OP3) -> DataFrame:
    """One document of each component, with the columns of docs."""
    ids = near_duplicates(docs, rule).where("not kept").select(F.col("doc_id").alias("_gone")).distinct().hint("shuffle_hash")
    return docs.join(ids, F.col("doc_id") == F.col("_gone"), "left_anti")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
