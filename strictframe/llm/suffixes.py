"""Suffix arrays of bytes by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified (S if smaller than the next one, else L; leftmost S
ones are LMS), LMS substrings are sorted by inducing from any order, named, the
reduced string of names is sorted, and the order of all suffixes is induced
from that of the LMS ones.  Inducing walks the buckets of first bytes; all
suffixes of one bucket are handled at once.  The reduced string has a large
alphabet, for which walking buckets is slow; its suffixes are sorted by rank
doubling.
"""

from __future__ import annotations

import numpy as np

from .quality import suffix_array as _by_doubling

_MIX = np.uint64(0x9E3779B97F4A7C15)


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is of type S, and the positions of the LMS suffixes; ``t`` ends in a unique least symbol."""
    n = len(t)
    unequal = np.flatnonzero(t[:-1] != t[1:])  # the type of an equal run is that of its end
    at = np.searchsorted(unequal, np.arange(n - 1))
    end = unequal[np.minimum(at, len(unequal) - 1)]
    s = np.empty(n, bool)
    s[:-1] = t[end] < t[end + 1]
    s[-1] = True
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    return s, lms


def _spread(sa: np.ndarray, where: np.ndarray, p: np.ndarray, c: np.ndarray, step: int) -> None:
    """Append suffixes p to the buckets c, in order; step -1 fills buckets from behind."""
    if not len(p):
        return
    order = np.argsort(c, kind="stable")
    c, p = c[order], p[order]
    counts = np.bincount(c, minlength=len(where))
    first = np.cumsum(counts) - counts
    sa[where[c] + step * (np.arange(len(c)) - first[c])] = p
    where += step * counts


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order of all suffixes induced from LMS suffixes in the given order."""
    n = len(t)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    sa = np.full(n, -1, np.int64)
    tails = ends - 1
    _spread(sa, tails, lms[::-1], t[lms[::-1]], -1)
    seeds_from = tails + 1  # LMS suffixes of bucket c: sa[seeds_from[c]:ends[c]]
    at = heads.copy()
    symbols = np.flatnonzero(sizes)
    for c in symbols.tolist():  # L suffixes, from the left
        done = heads[c]
        while done < at[c]:  # a run of c induces into its own bucket
            now = sa[done : at[c]]
            done = at[c]
            p = now - 1
            p = p[(p >= 0)]
            p = p[t[p] == c]
            sa[at[c] : at[c] + len(p)] = p
            at[c] += len(p)
        p = np.concatenate([sa[heads[c] : at[c]], sa[seeds_from[c] : ends[c]]]) - 1
        p = p[p >= 0]
        k = t[p]
        up = k > c
        _spread(sa, at, p[up], k[up], 1)
    l_until = at
    at = ends - 1
    for c in symbols[::-1].tolist():  # S suffixes, from the right
        done = ends[c] - 1
        # What was induced from greater buckets so far is sa[at[c] + 1 : ends[c]].
        while done > at[c]:
            now = sa[at[c] + 1 : done + 1][::-1]
            done = at[c]
            p = now - 1
            p = p[p >= 0]
            p = p[(t[p] == c) & s[p]]
            sa[at[c] - len(p) + 1 : at[c] + 1] = p[::-1]
            at[c] -= len(p)
        p = np.concatenate([sa[at[c] + 1 : ends[c]][::-1], sa[heads[c] : l_until[c]][::-1]]) - 1
        p = p[p >= 0]
        k = t[p]
        down = (k < c) & s[p]
        _spread(sa, at, p[down], k[down], -1)
    sa[0] = n - 1
    return sa


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of a uint8 array (without the end mark)."""
    if not len(data):
        return np.zeros(0, np.int64)
    t = np.append(data.astype(np.int64) + 1, 0)
    n = len(t)
    sizes = np.bincount(t, minlength=257)
    s, lms = classify(t)
    sa = _induce(t, s, lms, sizes)
    if len(lms) > 1:
        # LMS suffixes in the induced order: sorted by their LMS substrings.
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        # Each substring reaches to the next LMS position; equal ones agree in length and hash.
        number = np.empty(n, np.int64)
        number[lms] = np.arange(len(lms))
        upto = np.append(lms[1:], n - 1)
        with np.errstate(over="ignore"):
            odd = np.uint64(0xD6E8FEB86659FD93)
            powers = np.cumprod(np.full(int((upto - lms).max()) + 2, odd))
            symbol = (t.astype(np.uint64) * np.uint64(2) + s.astype(np.uint64) + np.uint64(1)) * _MIX
            symbol ^= symbol >> np.uint64(29)
            inside = np.arange(n) - np.repeat(np.append(0, lms), np.diff(np.append(np.append(0, lms), n)))
            inside = np.minimum(inside, len(powers) - 1)
            total = np.append(np.uint64(0), np.cumsum(symbol * powers[inside]))
            digest = total[upto] - total[lms] + symbol[upto] * powers[upto - lms]
        k = number[order]
        a, b = k[:-1], k[1:]
        differ = (digest[a] != digest[b]) | ((upto - lms)[a] != (upto - lms)[b])
        names = np.empty(len(lms), np.int64)
        names[k] = np.append(0, np.cumsum(differ))
        if differ.all():
            lms = order
        else:
            lms = lms[_by_doubling(names, np.zeros(len(names), np.int64))[0]]
        sa = _induce(t, s, lms, sizes)
    return sa[1:]


def repeated(data: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """Which positions share their first ``length`` bytes with another: permuted common prefixes, cut off at ``length``.

    Each suffix is compared with its predecessor in the array, eight bytes at a
    time, as long as they agree.
    """
    n = len(data)
    out = np.zeros(n, bool)
    if n < length:
        return out
    word = np.zeros(n, np.uint64)
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    for j in range(8):
        word |= padded[j : n + j] << np.uint64(8 * j)
    i, j = sa[1:], sa[:-1]
    fits = np.maximum(i, j) <= n - length
    i, j = i[fits], j[fits]
    for at in (*range(0, length - 7, 8), length - 8):
        same = word[i + at] == word[j + at]
        i, j = i[same], j[same]
        if not len(i):
            break
    out[i] = True
    out[j] = True
    return out
