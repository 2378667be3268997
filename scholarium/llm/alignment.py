"""Edit distance of word sequences in a band around the diagonal, many cells of a column at once."""

from __future__ import annotations

import numpy as np


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Words the two have in common, with multiplicity, whatever the order."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[ia], cb[ib]).sum())


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    cut = int(differ[0]) if len(differ) else n
    a, b = a[cut:], b[cut:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    cut = int(differ[0]) if len(differ) else n
    return a[: len(a) - cut], b[: len(b) - cut]


def _band(a: list[int], b: list[int], limit: int) -> int:
    """Distance of ``a`` to the not shorter ``b``, or limit + 1. One column of the band is one long integer.

    The vertical differences of a column are held as bits of two integers, and a column follows from the last one
    by word-wide logic. The lowest bit kept moves down one row with every column, so the integers
    are as wide as the band.
    """
    n, m = len(b), len(a)
    width = 2 * limit + 2
    full = (1 << width) - 1
    rows: dict[int, int] = {}
    for i, w in enumerate(b):
        rows[w] = rows.get(w, 0) | 1 << i
    up, down = full & ~((1 << (width - limit - 1)) - 1), 0
    dist, first = limit, limit + 1 - width
    edge, side = 1 << (width - 1), 1 << (width - 2)
    turn = max(0, n - limit)
    hopeless = 2 * limit + m - n
    for j in range(m):
        match = rows.get(a[j], 0)
        match = (match >> first if first >= 0 else match << -first) & full
        diag = ((((match & up) + up) ^ up) | match | down) & full
        grow, shrink = (down | ~(diag | up)) & full, diag & up
        if j < turn:
            dist += not diag & edge
        else:
            dist += (grow & side != 0) - (shrink & side != 0)
            side >>= 1
        if dist > hopeless:
            return limit + 1
        diag >>= 1
        up, down = (shrink | ~(diag | grow)) & full, diag & grow
        first += 1
    return min(dist, limit + 1)


def distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance, or ``limit`` + 1 where it is larger. Narrow bands are tried first."""
    if max(len(a), len(b)) - common(a, b) > limit or abs(len(a) - len(b)) > limit:
        return limit + 1
    a, b = _trim(a, b)
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return min(len(b), limit + 1)
    x, y = a.tolist(), b.tolist()
    tries = sorted({max(len(b) - len(a) + 4, limit // 8), limit})
    for t in tries:
        if t <= limit:
            t = min(t, len(b))
            d = _band(x, y, t)
            if d <= t:
                return d
    return limit + 1
