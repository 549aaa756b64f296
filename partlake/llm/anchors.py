"""Content-defined anchors of byte strings, and hashes of any of their substrings.

Every ``length``-byte string holds one anchor at least: the leftmost of its ``gram``-byte
strings with the least hash. The choice depends on these bytes alone, so equal strings
hold their anchor at the same place, and all repeats are found by comparing anchors.
"""

from __future__ import annotations

import numpy as np

from partlake.llm.shingles import mix

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)
_POS_BITS = 24
#: Longest byte string taken at once; longer documents are cut into overlapping stretches.
STRETCH = 1 << 22


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow))
        for name, base in (("_pow", _BASE), ("_inv", _BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            globals()[name] = np.cumprod(a, dtype=np.uint64)
    return _pow, _inv


class Hasher:
    """Hashes of substrings of one buffer, from prefix sums of a polynomial."""

    def __init__(self, data: bytes | np.ndarray):
        a = np.frombuffer(data, np.uint8)
        self.n = len(a)
        pw, self.inv = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + _U(1)) * pw[: self.n], out=self.sums[1:])

    def substrings(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.inv[starts]
        return mix(x + (ends - starts).astype(np.uint64) * _U(0xD1B54A32D192ED03))

    def grams(self, size: int) -> np.ndarray:
        """Hash of the ``size`` bytes from each position."""
        m = self.n - size + 1
        x = (self.sums[size:] - self.sums[:m]) * self.inv[:m]
        return mix(x + _U(size * 0xD1B54A32D192ED03 % (1 << 64)))


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values, by prefix and suffix minima of blocks."""
    n = len(v)
    pad = -n % w
    x = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def find_anchors(h: Hasher, bounds: np.ndarray, length: int, gram: int):
    """Anchors of all strings of ``length`` bytes inside the documents of a buffer.

    ``bounds`` are the documents' (start, end) rows, ascending. Returns arrays: document
    number, anchor position, hash of its gram, and the first and last start of the strings
    that hold it (contiguous).
    """
    none = np.zeros(0, np.int64)
    if h.n < length:
        return none, none, none.astype(np.uint64), none, none
    v = h.grams(gram)
    packed = (v >> _U(_POS_BITS) << _U(_POS_BITS)) | np.arange(len(v), dtype=np.uint64)
    best = (_window_min(packed, length - gram + 1) & _U((1 << _POS_BITS) - 1)).astype(np.int64)  # by start of string
    long = bounds[:, 1] - bounds[:, 0] >= length
    docs = np.flatnonzero(long)
    if not len(docs):
        return none, none, none.astype(np.uint64), none, none
    n = bounds[docs, 1] - bounds[docs, 0] - length + 1
    own = np.repeat(docs, n)
    first = np.cumsum(n) - n
    start = np.arange(len(own)) - np.repeat(first - bounds[docs, 0], n)
    a = best[start]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (own[1:] != own[:-1])]))
    last = np.concatenate([new[1:], [len(a)]]) - 1
    return own[new], a[new], v[a[new]], start[new], start[last]
