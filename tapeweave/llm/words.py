"""Words of texts as 64-bit hashes, a whole batch at once in numpy.

A word is a run of bytes other than white space (0x20, 0x09-0x0D), with A-Z lower-cased. Its hash is a polynomial over
random values of its bytes, mixed; for V different words, two share a hash with probability V * V / 2**65.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads a 64-bit number's bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
VALUE = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE))[LOWER]
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, and how many each text has."""
    if not raw:
        return np.empty(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    inside = WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    power, inverse = powers(len(data))
    total = np.cumsum(VALUE[data] * power[: len(data)])
    hashes = mixed((total[end - 1] - total[start - 1]) * inverse[start])
    closes = np.cumsum([len(x) + 1 for x in raw])
    return hashes, np.diff(np.searchsorted(start, closes), prepend=0)
