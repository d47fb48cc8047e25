"""Vectorised word hashing: the words of a text become 64-bit hashes without a Python loop over words."""

from __future__ import annotations

import numpy as np

_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything but ASCII letters and digits and the bytes of other scripts.
_MARKS = np.ones(256, bool)
_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2^64, for texts of up to n bytes."""
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, base in enumerate((_ODD, _INVERSE)):
            step = np.full(m, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, marks: bool = False) -> np.ndarray:
    """A hash for each word in order. Words end at ASCII white space, or with ``marks`` at ASCII punctuation too."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = ~(_MARKS if marks else _SPACE)[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    up, down = _grow(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(up[: len(raw)] * (raw.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of equally long columns; order counts."""
    out = np.full(len(parts[0]), 0x51ED270B, np.uint64)
    for p in parts:
        out = mixed(out * np.uint64(_ODD) + p)
    return out


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``words`` words; a shorter text is one run of all it has, an empty one none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    return np.unique(chained([w[i : len(w) - k + 1 + i] for i in range(k)]))


def set_digest(items: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes as two signed numbers: equal sets agree, and others don't in practice."""
    a, b = mixed(items).sum(dtype=np.uint64), mixed(items ^ np.uint64(_ODD)).sum(dtype=np.uint64)
    return tuple(int(x) - ((int(x) >> 63) << 64) for x in (a, mixed(np.array([b + np.uint64(len(items))]))[0]))
