"""The binary Golay code of length 23: every word is within 3 bits of exactly one of 4096 codewords."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

N, K = 23, 12
#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the cyclic code.
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for shift in range(N - 1, N - K - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - (N - K))
    return word


@lru_cache(maxsize=1)
def _leaders() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the single bits, and for each of the 2048 syndromes the error of at most 3 bits that has it."""
    bits = np.array([_remainder(1 << i) for i in range(N)], dtype=np.int64)
    errors = np.zeros(2048, dtype=np.int64)
    for i in range(N):
        errors[bits[i]] = 1 << i
        for j in range(i):
            errors[bits[i] ^ bits[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[bits[i] ^ bits[j] ^ bits[k]] = 1 << i | 1 << j | 1 << k
    return bits, errors


def syndromes(words: np.ndarray) -> np.ndarray:
    bits, _ = _leaders()
    out = np.zeros(words.shape, dtype=np.int64)
    for i in range(N):
        out ^= np.where(words >> i & 1, bits[i], 0)
    return out


def decode(words: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the codeword nearest to each 23-bit word."""
    _, errors = _leaders()
    return (words ^ errors[syndromes(words)]) >> (N - K)


@lru_cache(maxsize=1)
def _ball_shifts() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the distinct codeword offsets met within one bit flip: (2048, 6) errors to subtract, and how many there are.

    A word within 2 bits of its codeword meets only that one; a word 3 bits away meets 5 others.
    """
    bits, errors = _leaders()
    table, count = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for s in range(2048):
        met = dict.fromkeys([int(errors[s]), *(int(errors[s ^ bits[i]]) ^ (1 << i) for i in range(N))])
        table[s, : len(met)] = list(met)
        count[s] = len(met)
    return table, count


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts): for each word the indices of all codewords to which it or a word one bit away decodes, padded to 6.

    Two words at most 2 bits apart have a word in common that is at most one bit from either, so they share a key.
    """
    table, count = _ball_shifts()
    s = syndromes(words)
    return (words[:, None] ^ table[s]) >> (N - K), count[s]
