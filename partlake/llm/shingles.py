"""Word shingles of many texts at once, as 64-bit hashes in numpy.

Words are runs without space and U+0009 to U+000D; A to Z count as a to z. A text's
set holds every distinct run of ``k`` words; a text of fewer words has its whole word
sequence as the only member, one without words has none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (multiply, shift, xor)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Sets:
    """Distinct shingle hashes of each text, ascending, one after the other; text i owns ``flat[ends[i-1]:ends[i]]``."""

    flat: np.ndarray
    size: np.ndarray
    key: np.ndarray  # hash of the whole set

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.size)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text number of each word), in order."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    a = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    blank = _BLANK[a]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = ends - starts
    at = np.flatnonzero(~blank)
    first = np.cumsum(n) - n
    off = np.arange(len(at)) - np.repeat(first, n)
    # each byte is mixed with its place before the sum: powers of a base modulo 2^64 would collide on words of a known form
    h = np.add.reduceat(mix((a[at].astype(np.uint64) + _U(1)) + off.astype(np.uint64) * _U(_STEP)), first)
    text_end = np.cumsum([len(x) + 1 for x in raw])
    return mix(h + n.astype(np.uint64) * _U(0xD1B54A32D192ED03)), np.searchsorted(text_end, starts - 1, side="right")


def shingle_sets(texts: list[str | None], k: int) -> Sets:
    words, owner = word_hashes(texts)
    n_texts = len(texts)
    per = np.bincount(owner, minlength=n_texts)
    if len(words) >= k:
        acc = mix(words[: len(words) - k + 1] + _U(k))
        for j in range(1, k):
            acc = mix(acc * _U(3) + words[j : len(words) - k + 1 + j])
        whole = owner[: len(owner) - k + 1] == owner[k - 1 :]
        flat, own = acc[whole], owner[: len(owner) - k + 1][whole]
    else:
        flat, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((per > 0) & (per < k))
    if len(short):
        first = np.cumsum(per) - per
        more = np.zeros(len(short), np.uint64)
        for i, t in enumerate(short.tolist()):
            acc1 = np.array([per[t]], np.uint64)
            for w in words[first[t] : first[t] + per[t]]:
                acc1 = mix(acc1 * _U(3) + w)
            more[i] = acc1[0]
        flat, own = np.concatenate([flat, more]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        flat, own = flat[order], own[order]
    counts = np.bincount(own, minlength=n_texts)
    end = 0
    for c in counts.tolist():
        flat[end : end + c].sort()
        end += c
    fresh = np.ones(len(flat), bool)
    if len(flat) > 1:
        fresh[1:] = (flat[1:] != flat[:-1]) | (own[1:] != own[:-1])
    flat, own = flat[fresh], own[fresh]
    size = np.bincount(own, minlength=n_texts)
    key = np.zeros(n_texts, np.uint64)
    some = size > 0
    if len(flat):
        key[some] = np.add.reduceat(mix(flat + _U(0x632BE59BD9B4E019)), (np.cumsum(size) - size)[some])
    return Sets(flat, size.astype(np.int64), mix(key + size.astype(np.uint64)))

