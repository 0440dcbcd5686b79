"""The binary Golay code of length 23: every 23-bit word is within 3 bits of exactly one of 4096 code words."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

N = 23
# Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def remainder(word: int) -> int:
    """Of the word as a polynomial, modulo the generator: its syndrome (11 bits)."""
    for i in range(N - 1, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; for each syndrome the error patterns of up to 4 bits, nearest first."""
    low = np.array([remainder(x) for x in range(1 << 12)], dtype=np.int32)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], dtype=np.int32)
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(N), weight):
            e = sum(1 << b for b in bits)
            errors[remainder(e)].append(e)
    most = max(map(len, errors))
    table = np.array([x + [-1] * (most - len(x)) for x in errors], dtype=np.int32)
    return low, high, table


def keys(words: np.ndarray) -> np.ndarray:
    """Indices (0 to 4095) of the code words within 4 bits of each word: the nearest one, then up to 5 more, then -1.

    Two words that differ in one bit at most share a key: the nearest code word
    of one is within 4 bits of the other.
    """
    low, high, table = _tables()
    words = words.astype(np.int32)
    errors = table[low[words & 0xFFF] ^ high[words >> 12]]
    index = (words[:, None] ^ errors) >> 11  # the code is systematic: its upper 12 bits name the code word
    return np.where(errors >= 0, index, -1)
