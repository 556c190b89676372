"""Leading eigenpairs of a small dense symmetric matrix: Householder tridiagonalisation, bisection by Sturm counts, inverse
iteration with reorthogonalisation inside clusters."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal q with q.T @ a @ q tridiagonal, by one reflection a column."""
    a, d = np.array(a, float), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k]
        if not x[1:].any():
            continue
        v = x / np.abs(x).max()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: the negative pivots of the shifted matrix."""
    tiny = EPS * max(float(np.abs(diagonal).max(initial=0)), float(np.abs(off).max(initial=0)), np.finfo(float).tiny / EPS)
    pivot = diagonal[0] - at
    below = (pivot < 0).astype(int)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - at - off[i - 1] ** 2 / pivot
        below += pivot < 0
    return below


def largest_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its interval can't be split."""
    d = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    margin = EPS * d * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - margin, high + margin
    rank = d - 1 - np.arange(k)  # so many eigenvalues lie below the wanted one
    for _ in range(200):
        middle = (low + high) / 2
        if not ((middle > low) & (middle < high)).any():
            break
        above = sturm_counts(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """x of (T - shift) x = right, by elimination with row exchanges; vanishing pivots count as ``tiny``."""
    d = len(diagonal)
    main, upper, second, x = diagonal - shift, np.append(off, 0.0), np.zeros(d), right.astype(float).copy()
    for i in range(d - 1):
        below, after = off[i], upper[i + 1]
        if abs(below) > abs(main[i]):
            ratio = main[i] / below
            main[i], upper[i], second[i], main[i + 1], upper[i + 1] = below, main[i + 1], after, upper[i] - ratio * main[i + 1], -ratio * after
            x[i], x[i + 1] = x[i + 1], x[i] - ratio * x[i + 1]
        else:
            main[i] = main[i] if abs(main[i]) > tiny else tiny
            ratio = below / main[i]
            main[i + 1] -= ratio * upper[i]
            x[i + 1] -= ratio * x[i]
    for i in range(d - 1, -1, -1):
        pivot = main[i] if abs(main[i]) > tiny else tiny
        x[i] = (x[i] - (upper[i] * x[i + 1] if i + 1 < d else 0) - (second[i] * x[i + 2] if i + 2 < d else 0)) / pivot
    return x


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as columns. Values that differ by less than a thousandth of the norm form a cluster, whose vectors are
    made orthogonal to each other in every step."""
    d, k = len(diagonal), len(values)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0)) or 1.0
    out, random, first = np.zeros((d, k)), np.random.Generator(np.random.PCG64(7)), 0
    for j in range(k):
        if j and values[j - 1] - values[j] > 1e-3 * norm:
            first = j
        x = random.standard_normal(d)
        for _ in range(6):
            x = solved(diagonal, off, values[j] - 2 * EPS * norm * (j - first), x / np.abs(x).max(), EPS * norm)
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns, the largest entry of each positive."""
    d, k = len(a), min(k, len(a))
    scale = float(np.abs(a).max(initial=0))
    if not scale:
        return np.zeros(k), np.eye(d)[:, :k]
    diagonal, off, q = tridiagonal(a / scale)
    values = largest_values(diagonal, off, k)
    found = q @ vectors(diagonal, off, values)
    found *= np.where(found[np.abs(found).argmax(0), np.arange(k)] < 0, -1, 1)
    return values * scale, found
