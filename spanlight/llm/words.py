"""Words of Arrow text columns as numpy arrays: their places, and fingerprints of words and of runs of words."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_A, _C = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_REACH = 64


def bytes_of(pattern_bytes) -> np.ndarray:
    """A table that tells for each byte whether it is one of those given."""
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


#: The white space of the contracts.
BLANK = bytes_of([0x20, *range(0x09, 0x0E)])


def table(seed: int) -> np.ndarray:
    """Random numbers for each byte at each of 64 places."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, _REACH * 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> _U(32)
    x *= _C
    x ^= x >> _U(29)
    return x


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Fingerprints of pairs; the order of a pair counts."""
    x = left * _A
    x += right
    x ^= x >> _U(32)
    x *= _C
    x ^= x >> _U(29)
    return x


def spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and value of each word of data, whose values lie at ``offsets`` (from 0 to its length); no word crosses values."""
    inside = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    np.logical_not(inside[:-1], out=before[1:])
    np.logical_not(inside[1:], out=after[:-1])
    starts = np.flatnonzero(inside & (edge[:-1] | before))
    ends = np.flatnonzero(inside & (edge[1:] | after)) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray, blank: np.ndarray = BLANK) -> np.ndarray:
    """Of each word that ``spans`` finds: sums of the numbers of its bytes at their places, mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    letters = data[~blank[data]]
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    values = numbers[((place & (_REACH - 1)) << 8) | letters]
    if int(lengths.max()) > _REACH:
        values *= mixed((place >> 6).astype(np.uint64)) | _U(1)
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _C)


def grams(h: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Fingerprints of 1, 2, 4, ... consecutive words, up to ``most``, at every word where as many follow."""
    out, n = {1: h}, 1
    while 2 * n <= most:
        h = pair(h[: max(0, len(h) - n)], h[n:])
        n *= 2
        out[n] = h
    return out
