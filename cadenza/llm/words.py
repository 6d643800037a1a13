"""Vectorised word splitting and hashing of whole texts, used inside tasks.

Texts are joined into one byte buffer; a lookup table lower-cases A-Z and marks word bytes (letters, digits and all
bytes from 0x80, so UTF-8 sequences stay whole). A word's hash is a polynomial over its bytes, read off prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


@dataclass
class Words:
    """Words of some texts in order: index of the text and 64-bit hash; ``first[i]:first[i+1]`` are those of text i."""

    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``k`` words from each word on, and whether they lie in one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.full(n, np.uint64(k), np.uint64)
        for j in range(k):
            h = mix(h * BASE + self.hash[j : j + n])
        return h, self.doc[:n] == self.doc[k - 1 : k - 1 + n]


def split_words(texts: list[str | None]) -> Words:
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    buf = FOLD[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
    isw = np.zeros(len(buf) + 1, np.int8)
    isw[1:] = WORD[buf]
    edges = np.flatnonzero(np.diff(isw))
    starts, ends = edges[::2], edges[1::2]
    pw, inv = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[: len(buf)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
    doc = np.searchsorted(at, starts, side="right") - 1
    return Words(doc, h, np.searchsorted(doc, np.arange(len(raw) + 1)))


def slices(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together; a longer text stands alone and stays whole."""
    lo = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)
