"""Counts of short sequences of word ids within one task: burstable array containers under a shallow trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Sequences of a container before it bursts, and of a trie before it spills.
BURST, MOST = 1 << 15, 1 << 20
Entries = tuple[np.ndarray, np.ndarray]  # (depth, n) ids and n counts, by rising ids


def distinct(ids: np.ndarray, counts: np.ndarray) -> Entries:
    """Equal sequences as one with the sum of their counts, by rising ids."""
    if ids.shape[1] < 2:
        return ids, counts
    rank = np.unique(ids[0], return_inverse=True)[1].astype(np.uint64)
    for column in ids[1:]:
        values, own = np.unique(column, return_inverse=True)
        rank = np.unique(rank * np.uint64(len(values)) + own.astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    where = np.empty(int(rank.max()) + 1, np.int64)
    where[rank] = np.arange(len(rank))
    sums = np.zeros(len(where), np.int64)
    np.add.at(sums, rank.astype(np.int64), counts)
    return ids[:, where], sums


class Container:
    """Sequences whose id at the node's level lies in one range; they share all ids above. New ones are only put aside until
    they double what is there."""

    def __init__(self, parts: list[Entries]):
        self.parts, self.size = parts, sum(p.shape[1] for p, _ in parts)
        self.settled = self.size if len(parts) == 1 else 0

    def put(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((ids.copy(), counts.copy()))  # a view would hold the whole block
        self.size += ids.shape[1]

    def settle(self) -> Entries:
        if len(self.parts) != 1:
            self.parts = [distinct(np.concatenate([p for p, _ in self.parts], 1), np.concatenate([c for _, c in self.parts]))] if self.parts else []
            self.size = self.settled = self.parts[0][0].shape[1] if self.parts else 0
        return self.parts[0] if self.parts else (np.zeros((0, 0), np.uint64), np.zeros(0, np.int64))

    def entries(self) -> Iterator[Entries]:
        if self.size:
            yield self.settle()


class Node:
    """Children by ranges of the id at ``level``; a container that bursts becomes two ranges, or, if it holds a single id, a node below."""

    def __init__(self, level: int, children: list):
        self.level, self.low, self.children = level, np.zeros(1, np.uint64), children

    @property
    def size(self) -> int:
        return sum(c.size for c in self.children)

    def put(self, ids: np.ndarray, counts: np.ndarray, burst: int) -> None:
        """ids rise."""
        cuts = np.append(np.searchsorted(ids[self.level], self.low), ids.shape[1])
        for i in reversed(range(len(self.children))):
            a, b = int(cuts[i]), int(cuts[i + 1])
            if a == b:
                continue
            child = self.children[i]
            if isinstance(child, Node):
                child.put(ids[:, a:b], counts[a:b], burst)
                continue
            child.put(ids[:, a:b], counts[a:b])
            if child.size > max(burst, 2 * child.settled):
                child.settle()
                self.split(i, burst)

    def split(self, i: int, burst: int) -> None:
        stack = [i]
        while stack:
            i = stack.pop()
            child = self.children[i]
            if child.size <= burst:
                continue
            ids, counts = child.settle()
            at = ids[self.level]
            middle = at[len(at) // 2]
            cut = int(np.searchsorted(at, middle)) or int(np.searchsorted(at, middle, "right"))
            if cut < len(at):
                self.low = np.insert(self.low, i + 1, at[cut])
                self.children[i : i + 1] = [Container([(ids[:, a:b].copy(), counts[a:b].copy())]) for a, b in ((0, cut), (cut, len(at)))]
                stack += [i, i + 1]
            elif self.level + 1 < len(ids):
                below = Node(self.level + 1, [child])
                below.split(0, burst)
                self.children[i] = below

    def entries(self) -> Iterator[Entries]:
        for child in self.children:
            yield from child.entries()


class HatTrie:
    """``put`` counts sequences; ``spill`` hands whole subtrees out as sorted runs while the trie holds too much, all of them at the end."""

    def __init__(self, burst: int = BURST, most: int = MOST):
        self.burst, self.most, self.root = burst, most, Node(0, [Container([])])

    def put(self, ids: np.ndarray) -> None:
        """ids: a row for each place in the sequence, a column a sequence."""
        if ids.shape[1]:
            self.root.put(*distinct(ids, np.ones(ids.shape[1], np.int64)), self.burst)

    def spill(self, everything: bool = False) -> Iterator[Entries]:
        if not everything and self.root.size <= self.most:
            return
        sizes = [c.size for c in self.root.children]
        order, left = sorted(range(len(sizes)), key=lambda i: -sizes[i]), sum(sizes)
        out = set()
        for i in order:
            if everything or left > self.most // 2:
                out.add(i)
                left -= sizes[i]
        for i in sorted(out):
            yield from self.root.children[i].entries()
            self.root.children[i] = Container([])
