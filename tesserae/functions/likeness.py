"""The ratio of `difflib.SequenceMatcher` over two texts, digit for digit, without a look at whole texts for every block."""

from __future__ import annotations

import difflib
from bisect import bisect_left

import numpy as np

#: Places where two letters in a row meet two in a row that are held at once; texts with more go to `difflib`.
MOST = 2_000_000


def ratio(x: str, y: str) -> float:
    """What `SequenceMatcher(None, x, y).ratio()` gives."""
    whole = len(x) + len(y)
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    found = _matched(x, y)
    return difflib.SequenceMatcher(None, x, y).ratio() if found is None else 2.0 * found / whole


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _before(rare: np.ndarray, codes: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending) whose letter and the one before are both rare, and a number for each such two letters."""
    at = rare[1:][np.diff(rare) == 1]
    return at, codes[at - 1].astype(np.int64) * letters + codes[at]


def _met(a: np.ndarray, a_keys: np.ndarray, b: np.ndarray, b_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Places (i, j), in order, at which runs of two or more rare letters that are equal end, and how long these are; None if they are too many."""
    by_key = np.argsort(b_keys, kind="stable")
    held = b_keys[by_key]
    first = np.searchsorted(held, a_keys)
    n = np.searchsorted(held, a_keys, "right") - first
    total = int(n.sum())
    if total > MOST:
        return None
    i = np.repeat(a, n)
    j = b[by_key[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]]
    # Along a diagonal a run grows by one from each place to the next.
    order = np.lexsort((i, j - i))
    di, dd = i[order], (j - i)[order]
    at = np.arange(total)
    begins = np.ones(total, bool)
    begins[1:] = (np.diff(di) != 1) | (np.diff(dd) != 0)
    size = np.empty(total, np.int64)
    size[order] = at - np.maximum.accumulate(np.where(begins, at, 0)) + 2
    return i, j, size


def _matched(x: str, y: str) -> int | None:
    """How many letters the matching blocks have.

    The matcher looks for the longest run of equal letters that aren't frequent in y, the first of these in x and then in y, lets it
    grow over whatever is equal on both sides, and goes on to the left and the right of it. To the right no run is
    longer and to the left all are shorter; so all runs of one length in a field are taken in one pass from left to right, and
    what lies between them is left to shorter ones. Fields without a run of two go letter by letter, where the first
    letter of x that has a fellow is the next block. A field without such letters gives the beginning that both have.
    """
    letters, b, counts = np.unique(_codes(y), return_inverse=True, return_counts=True)
    frequent = counts > len(y) // 100 + 1 if len(y) >= 200 else np.zeros(len(letters), bool)
    xs = _codes(x)
    a = np.minimum(np.searchsorted(letters, xs), len(letters) - 1)
    rare_a = np.flatnonzero((letters[a] == xs) & ~frequent[a])
    rare_b = np.flatnonzero(~frequent[b])
    runs = _met(*_before(rare_a, a, len(letters)), *_before(rare_b, b, len(letters)))
    if runs is None:
        return None
    by_letter = rare_b[np.argsort(b[rare_b], kind="stable")]
    ends = np.cumsum(np.where(frequent, 0, counts)).tolist()
    of = a[rare_a].tolist()
    places = {c: by_letter[(ends[c - 1] if c else 0) : ends[c]].tolist() for c in set(of)}
    rows = rare_a.tolist()
    matched = 0

    def grown(i: int, j: int, n: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        while i > alo and j > blo and x[i - 1] == y[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < ahi and j + n < bhi and x[i + n] == y[j + n]:
            n += 1
        return i, j, n

    fields = [(0, len(x), 0, len(y), *runs)]
    while fields:
        alo, ahi, blo, bhi, i, j, size = fields.pop()
        if alo >= ahi or blo >= bhi:
            continue
        if len(i):
            here = slice(*np.searchsorted(i, (alo + 1, ahi)))
            i, j, size = i[here], j[here], size[here]
            inside = (j > blo) & (j < bhi)
            i, j, size = i[inside], j[inside], size[inside]
        if len(i):
            held = np.minimum(size, np.minimum(i - alo, j - blo) + 1)
            most = int(held.max())
            best = np.flatnonzero(held == most)
            for p, q in zip(i[best].tolist(), j[best].tolist(), strict=True):
                p, q = p - most + 1, q - most + 1
                if p >= alo and q >= blo:
                    p, q, n = grown(p, q, most, alo, ahi, blo, bhi)
                    matched += n
                    fields.append((alo, p, blo, q, i, j, size))
                    alo, blo = p + n, q + n
            fields.append((alo, ahi, blo, bhi, i, j, size))
            continue
        for k in range(bisect_left(rows, alo), bisect_left(rows, ahi)):
            p = rows[k]
            if p < alo:
                continue
            fellows = places[of[k]]
            t = bisect_left(fellows, blo)
            if t < len(fellows) and fellows[t] < bhi:
                p, q, n = grown(p, fellows[t], 1, alo, ahi, blo, bhi)
                matched += n + grown(alo, blo, 0, alo, p, blo, q)[2]
                alo, blo = p + n, q + n
        matched += grown(alo, blo, 0, alo, ahi, blo, bhi)[2]
    return matched
