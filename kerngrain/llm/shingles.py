"""Word shingles and minhashes of whole texts, for many texts at a time (NumPy inside tasks).

Words are runs of bytes other than space, \\t, \\n, \\v, \\f and \\r, with A-Z lower-cased. A word's code is a polynomial in its
bytes modulo 2**64, so that the codes of all words of a batch come from one running sum; shingles mix the codes of
their words. Every code has 64 bits and depends on nothing but the words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_MASK = 2**64 - 1
_RNG = np.random.default_rng(20240229)
#: A code for each byte; capitals have their small letters' codes.
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & _MASK))
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the base and of its inverse, kept for the longest batch so far."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return self.up[:n], self.down[:n]


def word_codes(texts: list[str | None], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of the texts in order, and the text (by position) that each is in."""
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    sizes = np.array([len(x) + 1 for x in raw], dtype=np.int64)
    data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)  # a space after each text
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers.upto(len(data) + 1)
    total = np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)
    before = np.where(begin > 0, total[begin - 1], np.uint64(0))
    codes = mix((total[end - 1] - before) * down[begin] + (end - begin).astype(np.uint64))
    return codes, np.searchsorted(np.cumsum(sizes), begin, side="right")


def shingle_sets(texts: list[str | None], size: int, powers: Powers) -> list[np.ndarray]:
    """Of each text the sorted distinct codes of its shingles of ``size`` words.

    Fewer words than that: the whole sequence as one shingle. No words or null: none.
    """
    codes, text = word_codes(texts, powers)
    counts = np.bincount(text, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)])
    n = len(codes)
    h = np.full(n, np.uint64(size))
    for k in range(size):
        h[: max(0, n - k)] = mix(h[: max(0, n - k)] * _GOLDEN + codes[k:])
    out = []
    for i, c in enumerate(counts):
        if c >= size:
            out.append(np.unique(h[first[i] : first[i + 1] - size + 1]))
        elif c:
            short = np.full(1, np.uint64(c))
            for x in codes[first[i] : first[i + 1]]:
                short = mix(short * _GOLDEN + x)
            out.append(short)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def hash_family(n: int, seed: int = 7919) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minhashes(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the non-empty sets the minimum of each hash function: an array of sets by functions."""
    codes = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    out = np.empty((len(sets), len(a)), dtype=np.uint64)
    for i in range(len(a)):
        x = codes * a[i] + b[i]
        x ^= x >> np.uint64(29)
        out[:, i] = np.minimum.reduceat(x, starts)
    return out


def parts(texts: Iterable[str | None], limit: int = 2_000_000) -> Iterator[slice]:
    """Slices of the texts with about so many characters each; a longer text is a slice of its own."""
    begin = size = at = 0
    for at, x in enumerate(texts, 1):
        size += len(x or "")
        if size >= limit:
            yield slice(begin, at)
            begin, size = at, 0
    if begin < at:
        yield slice(begin, at)
