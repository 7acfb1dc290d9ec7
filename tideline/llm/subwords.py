"""Words of a text and the hashed character n-grams of words, as numpy arrays.

A word is a run of letters; runs of more than ``LONGEST`` letters (scripts without spaces) are taken in pieces of that length, so
whole texts are covered. N-grams see the word between two marks, so those at its ends are affixes.
"""

from __future__ import annotations

import re

import numpy as np

LONGEST = 30
WORD = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
_START, _END = 2, 3


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def ngrams(vocabulary: list[str], lo: int, hi: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, owner): bucket ids of every n-gram and of the whole word, and which word each belongs to, words in order."""
    n = len(vocabulary)
    width = max((len(w) for w in vocabulary), default=1)
    codes = np.zeros((n, width + 2), np.uint64)
    codes[:, 1:-1] = np.array(vocabulary, f"<U{width}").view("<u4").reshape(n, width)
    length = np.fromiter(map(len, vocabulary), np.int64, n)
    codes[:, 0] = _START
    codes[np.arange(n), length + 1] = _END
    length = length + 2
    with np.errstate(over="ignore"):
        powers = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, width + 3, dtype=np.uint64)
        ids, ok = [_bucket(codes @ powers + np.uint64(1), buckets)[:, None]], [np.ones((n, 1), bool)]
        for k in range(lo, hi + 1):
            at = width + 3 - k
            if at <= 0:
                continue
            h = np.full((n, at), k, np.uint64)
            for j in range(k):
                h = h * np.uint64(0x100000001B3) ^ codes[:, j : j + at]
                h ^= h >> np.uint64(29)
            ids.append(_bucket(h, buckets))
            ok.append(np.arange(at)[None, :] + k <= length[:, None])
    flat, mask = np.concatenate(ids, axis=1), np.concatenate(ok, axis=1)
    return flat[mask], np.repeat(np.arange(n), mask.sum(axis=1))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def per_word(weights: np.ndarray, vocabulary: list[str], lo: int, hi: int, mean: bool, chunk: int = 8192) -> np.ndarray:
    """Sum or mean, for each word, of the rows of ``weights`` at its n-grams."""
    out = np.zeros((len(vocabulary), weights.shape[1]), np.float64)
    for at in range(0, len(vocabulary), chunk):
        part = vocabulary[at : at + chunk]
        ids, owner = ngrams(part, lo, hi, len(weights))
        count = np.bincount(owner, minlength=len(part))
        for j in range(weights.shape[1]):
            out[at : at + len(part), j] = np.bincount(owner, weights[ids, j], minlength=len(part))
        if mean:
            out[at : at + len(part)] /= np.maximum(count, 1)[:, None]
    return out


class WordTable:
    """Rows for words, made once for each word of a batch and kept while there is room."""

    def __init__(self, make, most: int = 200_000):
        self.make, self.most, self.of = make, most, {}
        self.rows = np.zeros((0, 0))

    def ids(self, tokens: list[str]) -> np.ndarray:
        """Row numbers of the tokens; valid until the next call of ``room``."""
        of = self.of
        new = [w for w in dict.fromkeys(tokens) if w not in of]
        if new:
            made = self.make(new)
            base = len(of)
            of.update(zip(new, range(base, base + len(new)), strict=True))
            if base + len(new) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), base + len(new), 1024), made.shape[1]), made.dtype)
                if base:
                    grown[:base] = self.rows[:base]
                self.rows = grown
            self.rows[base : base + len(new)] = made
        return np.fromiter(map(of.__getitem__, tokens), np.int64, len(tokens))

    def room(self) -> None:
        if len(self.of) > self.most:
            self.of, self.rows = {}, self.rows[:0]
