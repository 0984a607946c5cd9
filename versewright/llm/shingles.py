"""Hashed word shingles in numpy, for the operators that compare texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a Python worker keeps.
KEPT = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """64-bit hashes by word."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


WORDS = Words()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def combined(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k values from each place on; fewer than k values make one hash of all, none make none."""
    k = min(k, len(h))
    if not k:
        return h[:0]
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _ODD + h[j : j + n]
    return mixed(out + np.uint64(k))


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles of a text in lower case, in their order."""
    return combined(word_hashes((text or "").lower().split()), k)


def labelled(h: np.ndarray) -> np.ndarray:
    """h with the number of its occurrence mixed into each value but the first of its kind, so that all differ."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    if new.all():
        return h
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = h.copy()
    out[order] = np.where(nth > 0, mixed(s + nth.astype(np.uint64) * _ODD), s)
    return out
