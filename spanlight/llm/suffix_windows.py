"""Sampled suffixes of byte strings, in numpy: which suffixes are sampled depends on content alone.

Every window of ``WINDOW`` bytes contains the k-gram of ``GRAM`` bytes with the least fingerprint, the leftmost of equals. Its place is
the window's anchor, and the suffix that starts there is sampled. Equal windows have anchors at the same place, so two
windows can only be equal if the sampled suffixes at their anchors share a prefix of ``GRAM`` bytes.
"""

from __future__ import annotations

import numpy as np

WINDOW, GRAM = 200, 64
_SLIDE = WINDOW - GRAM + 1
_U = np.uint64
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False) | _U(1)
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)
#: Low bits of a packed (fingerprint, place).
_PLACE = _U((1 << 31) - 1)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Fingerprints of pairs; the order of a pair counts."""
    x = left * _A
    x += right
    x ^= x >> _U(32)
    x *= _C
    x ^= x >> _U(29)
    return x


def fingerprints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the GRAM bytes and of the WINDOW bytes at every place; data holds WINDOW bytes at least."""
    h, n, gram = _TABLE[data], 1, None
    while n < 128:
        h = _join(h[:-n], h[n:])
        n *= 2
        if n == GRAM:
            gram = h
    return gram, _join(h[: len(h) - (WINDOW - 128)], h[WINDOW - 128 :])


def window_anchors(gram: np.ndarray) -> np.ndarray:
    """The anchor of the window at every place, as a place."""
    m = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    n = 1
    while n * 2 <= _SLIDE:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    m = np.minimum(m[: len(m) - (_SLIDE - n)], m[_SLIDE - n :])
    return (m & _PLACE).astype(np.int64)


def runs(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Maximal runs of windows with one anchor, over values data[offsets[i]:offsets[i + 1]]: value, first and last
    window start in the value, key (fingerprint of the anchor's k-gram), head (its first eight bytes, in their order),
    context (fingerprint of all bytes of the run's windows and of the anchor's place among them)."""
    base, end = int(offsets[0]), int(offsets[-1])
    data, offsets = data[base:end], offsets - base
    none = np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    if not (lengths >= WINDOW).any():
        return dict.fromkeys(("value", "first", "last", "key", "head", "context"), none)
    gram, window = fingerprints(data)
    anchor = window_anchors(gram)
    valid = np.zeros(len(window) + 1, np.int8)
    np.add.at(valid, offsets[:-1][lengths >= WINDOW], 1)
    np.add.at(valid, offsets[1:][lengths >= WINDOW] - WINDOW + 1, -1)
    places = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
    of = anchor[places]
    new = np.flatnonzero((of[1:] != of[:-1]) | (places[1:] != places[:-1] + 1)) + 1
    first, last = places[np.concatenate(([0], new))], places[np.concatenate((new - 1, [len(places) - 1]))]
    at = anchor[first]
    value = np.searchsorted(offsets, first, "right") - 1
    head = np.zeros(len(at), np.uint64)
    for i in range(8):
        head = (head << _U(8)) | data[at + i].astype(np.uint64)
    shape = ((at - first).astype(np.uint64) << _U(32)) | (last - first).astype(np.uint64)
    context = _join(_join(window[first], window[last]), _join(shape, gram[at]))
    return {"value": value, "first": first - offsets[value], "last": last - offsets[value], "key": gram[at].view(np.int64), "head": head.view(np.int64) ^ np.int64(-(1 << 63)), "context": context.view(np.int64)}
