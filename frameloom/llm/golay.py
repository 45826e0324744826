"""The perfect binary Golay code of 23 bits, 12 of them data, as a source of fuzzy hash keys.

Every word of 23 bits lies within 3 bits of exactly one codeword. The keys of a word are the data bits of the codewords that
the word and its neighbours at one bit decode to: one key where the codeword is within 2 bits, up to six where it is 3 away.
Two words that differ in at most two bits have a common neighbour, hence a common key; and if they differ in at most
one bit, the word that either decodes to is among the keys of the other. Shorter segments are padded with zeros, and only
their own bits are flipped.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS, DATA = 23, 12
CHECK = BITS - DATA
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the code's generator; a fixed value.
GENERATOR = 0xAE3


def _remainder(x: int) -> int:
    for bit in range(BITS - 1, CHECK - 1, -1):
        if x >> bit & 1:
            x ^= GENERATOR << (bit - CHECK)
    return x


#: Remainders of the data part alone, and the error pattern of each remainder.
_OF_DATA = np.array([_remainder(d << CHECK) for d in range(1 << DATA)], np.int64)
_ERROR = np.zeros(1 << CHECK, np.int64)
for _weight in range(4):
    for _bits in combinations(range(BITS), _weight):
        _pattern = sum(1 << b for b in _bits)
        _ERROR[_remainder(_pattern)] = _pattern


def decode(words: np.ndarray) -> np.ndarray:
    """Data bits of the codewords nearest to words of 23 bits."""
    rest = _OF_DATA[words >> CHECK] ^ (words & ((1 << CHECK) - 1))
    return (words ^ _ERROR[rest]) >> CHECK


def keys(words: np.ndarray, bits: int) -> np.ndarray:
    """All keys of segments of so many bits: a row each of bits + 1 columns, sorted, -1 where a key repeats."""
    flips = np.array([0, *(1 << b for b in range(bits))], np.int64)
    found = np.sort(decode(words[:, None] ^ flips), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found
