"""Suffix arrays by induced sorting (in numpy), and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their right
neighbour; an S suffix after an L suffix is a leftmost-smaller one.  Sorting
those is enough: two linear scans induce the order of all others.  The scans
run bucket by bucket: everything that a bucket holds is placed into the buckets
of the preceding symbols at once, in waves for runs of equal symbols.

The leftmost-smaller suffixes themselves are sorted by naming their substrings
(a first induced sort) and, where names repeat, by recursion on the string of
names: by the same scans while its alphabet is small, by doubling of name pairs
where it is large (a scan per bucket would cost more than it saves).
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
SMALL = 1024  # symbols of a recursive alphabet that is still scanned bucket by bucket


def smaller(s: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S. The last symbol is the only smallest one."""
    n = len(s)
    turn = np.flatnonzero(s[1:] != s[:-1])                   # last positions of the runs but the last
    rising = s[turn] < s[turn + 1]
    lengths = np.diff(np.concatenate(([-1], turn, [n - 1])))
    return np.repeat(np.append(rising, True), lengths)


def _ranks(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order by group, rank of each ordered element in its group)."""
    order = np.argsort(group.astype(np.uint16) if len(group) > 64 else group, kind="stable")  # 16 bits: a radix sort
    g = group[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return order, np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))


def _induce(s: np.ndarray, kind: np.ndarray, start: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array, given the leftmost-smaller suffixes in their order."""
    n, symbols = len(s), len(start) - 1
    sa = np.full(n, -1, dtype=np.int32)
    # leftmost-smaller suffixes at their buckets' ends
    c = s[lms]
    count = np.bincount(c, minlength=symbols)
    order, rank = _ranks(c)
    lms_from = start[1:] - count
    sa[lms_from[c[order]] + rank] = lms[order]
    head = start[:-1].copy()

    def place_left(batch: np.ndarray) -> None:
        prev = batch - 1
        prev = prev[prev >= 0]
        prev = prev[~kind[prev]]
        if len(prev):
            d = s[prev]
            order, rank = _ranks(d)
            d = d[order]
            sa[head[d] + rank] = prev[order]
            np.add.at(head, *np.unique(d, return_counts=True)) if len(d) > 64 else np.add.at(head, d, 1)

    for b in np.flatnonzero(np.diff(start)).tolist():
        at = int(start[b])
        while at < head[b]:
            upto = int(head[b])
            place_left(sa[at:upto])
            at = upto
        if count[b]:
            place_left(sa[lms_from[b]:start[b + 1]])
    tail = start[1:].copy()

    def place_right(batch: np.ndarray) -> None:
        prev = batch - 1
        prev = prev[prev >= 0]
        prev = prev[kind[prev]]
        if len(prev):
            d = s[prev]
            order, rank = _ranks(d)
            d = d[order]
            sa[tail[d] - 1 - rank] = prev[order]
            np.subtract.at(tail, *np.unique(d, return_counts=True)) if len(d) > 64 else np.subtract.at(tail, d, 1)

    for b in np.flatnonzero(np.diff(start))[::-1].tolist():
        at = int(start[b + 1])
        while at > tail[b]:
            downto = int(tail[b])
            place_right(sa[downto:at][::-1])
            at = downto
        if head[b] > start[b]:
            place_right(sa[start[b]:head[b]][::-1])
    return sa


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names by doubling the compared length."""
    n, width = len(names), 1
    rank = names.astype(np.int64)
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[:n - width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key)  # equal pairs get equal ranks, in whichever order they come
        k = key[order]
        fresh = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == n - 1 or width >= n:
            return order


def _as_before(s: np.ndarray, at: np.ndarray, size: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Which of the substrings equal the one before them (the first: none), symbol by symbol, a part of them at a time."""
    out = np.concatenate(([False], size[1:] == size[:-1]))
    rows = np.flatnonzero(out)
    upto = np.concatenate(([0], np.cumsum(size[rows])))
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, side="right")) - 1)
        part = rows[i:j]
        first = upto[i:j] - upto[i]
        step = np.arange(upto[j] - upto[i]) - np.repeat(first, size[part])
        out[part] = ~np.logical_or.reduceat(s[np.repeat(at[part], size[part]) + step] != s[np.repeat(at[part - 1], size[part]) + step], first)
        i = j
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of symbols 0.., whose last one is 0 and the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int32)
    symbols = int(s.max()) + 1
    kind = smaller(s)
    start = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols))))
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]).astype(np.int32) + np.int32(1)
    first = _induce(s, kind, start, lms)
    # leftmost-smaller substrings in order; equal neighbours share a name
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    end = np.full(n, n, dtype=np.int64)
    end[lms[:-1]] = lms[1:] + 1
    differs = ~_as_before(s, ordered, end[ordered] - ordered)
    differs[0] = False
    name_of = np.zeros(n, dtype=np.int64)
    name_of[ordered] = np.cumsum(differs)
    names = name_of[lms]
    kinds = int(names.max()) + 1
    if kinds == len(lms):
        order = np.argsort(names, kind="stable")
    elif kinds <= SMALL:
        order = suffix_array(names)
    else:
        order = _doubled(names)
    return _induce(s, kind, start, lms[order])


def shares_prefix(text: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """In text order: whether a suffix shares its first ``length`` bytes with the one before it in the array.

    The permuted view: each suffix is compared with its predecessor in the array, eight bytes at a time, in the
    order of the text, where neighbouring suffixes touch neighbouring memory.
    """
    n = len(text)
    phi = np.empty(n, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    padded = np.concatenate((text, np.zeros(length + 8, dtype=np.uint8)))
    view = np.lib.stride_tricks.as_strided(padded, (n + length, 8), (1, 1))
    eight = np.ascontiguousarray(view).view(U64).reshape(-1)
    at = np.flatnonzero((phi >= 0) & (np.arange(n) + length <= n) & (phi + length <= n))
    for o in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        at = at[eight[at + o] == eight[phi[at] + o]]
    out = np.zeros(n, dtype=bool)
    out[at] = True
    return out
