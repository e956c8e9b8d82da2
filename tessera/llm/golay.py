"""The perfect binary Golay code of length 23: every word lies within 3 of exactly one codeword."""

from __future__ import annotations

import numpy as np

LENGTH, INDEX_BITS, CHECK_BITS = 23, 12, 11
_GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for shift in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> shift & 1:
            word ^= _GENERATOR << (shift - CHECK_BITS)
    return word


_BITS = [_remainder(1 << i) for i in range(LENGTH)]


def _linear(first: int, bits: int) -> np.ndarray:
    """Syndromes of all words of ``bits`` bits that start at position ``first``."""
    out = np.zeros(1, np.int32)
    for i in range(first, first + bits):
        out = np.concatenate([out, out ^ _BITS[i]])
    return out


_LOW, _HIGH = _linear(0, 12), _linear(12, 11)


def syndromes(words: np.ndarray) -> np.ndarray:
    return _LOW[words & 0xFFF] ^ _HIGH[words >> 12]


def _patterns() -> np.ndarray:
    """By syndrome, the error patterns of weight 4 at most, lightest first; -1 where there are fewer than six."""
    from itertools import combinations

    by: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(5):
        for at in combinations(range(LENGTH), weight):
            s = 0
            for i in at:
                s ^= _BITS[i]
            by[s].append(sum(1 << i for i in at))
    return np.array([(x + [-1] * 6)[:6] for x in by], np.int64)


_ERRORS = _patterns()


def near(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within 4 of each word, the nearest first; -1 fills the rows up to six.

    Any twelve neighbouring bits of a cyclic codeword determine it: the index is its upper twelve.
    """
    errors = _ERRORS[syndromes(words)]
    found = (words[:, None] ^ errors) >> CHECK_BITS
    return np.where(errors < 0, -1, found)
