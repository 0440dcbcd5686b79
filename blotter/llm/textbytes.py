"""Texts of an Arrow batch as bytes in numpy, and vectorised word hashes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: ASCII white space: space and \\t to \\r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null is the empty text."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], raw[offsets[0]:offsets[-1]]


def spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole texts of at most ``most`` bytes together (one longer text is a run of its own)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base and its inverse, modulo 2**64, to the powers 0 to n - 1."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        n = max(n, 1 << 18)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.full(n, base, dtype=U64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def running(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte times power; ``range_hash`` gets the hash of any range from them."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data) + 1)[0][:len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same value for the same bytes, wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same value for the same word. Each byte is mixed with its place in the word before the sum, so that no pattern of
    letters cancels out (as some do, in words of a thousand letters, where powers are summed modulo 2**64)."""
    first = np.zeros(len(data), dtype=np.int64)
    first[start] = start
    place = np.arange(len(data)) - np.maximum.accumulate(first)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(mix((data.astype(U64) + U64(1)) * U64(_BASE) + place.astype(U64) * U64(0xD1B54A32D192ED03)), out=sums[1:])
    return mix(sums[end] - sums[start] + (end - start).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the words; a word never crosses texts. ``inside``: which bytes belong to words."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    on = ~SPACE[data] if inside is None else inside
    first = on.copy()
    first[1:] &= ~on[:-1]
    last = on.copy()
    last[:-1] &= ~on[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = on[at]
    before = offsets[1:][offsets[1:] > 0] - 1
    last[before] = on[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingles(word_hash: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the runs of ``size`` words; a shorter text is one shingle of all its words, no words: none."""
    counts = np.bincount(text, minlength=n_texts)
    begin = np.concatenate(([0], np.cumsum(counts)))
    out, owner = [], []
    n = len(word_hash)
    if n >= size:
        h = np.zeros(n - size + 1, dtype=U64)
        for i in range(size):
            h = h * U64(0x100000001B3) + word_hash[i:n - size + 1 + i]
        whole = text[:n - size + 1] == text[size - 1:]
        out.append(mix(h[whole]))
        owner.append(text[:n - size + 1][whole])
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        short = []
        for t in few:
            h = 0
            for x in word_hash[begin[t]:begin[t + 1]].tolist():
                h = (h * 0x100000001B3 + x) & 0xFFFFFFFFFFFFFFFF
            short.append(h + int(counts[t]) & 0xFFFFFFFFFFFFFFFF)
        out.append(mix(np.array(short, dtype=U64)))
        owner.append(few)
    if not out:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    h, who = np.concatenate(out), np.concatenate(owner)
    if len(out) > 1:
        order = np.argsort(who, kind="stable")
        h, who = h[order], who[order]
    return h, who
