"""Texts as one array of code points, and the words in it, for vectorised work inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_POWERS = np.ones(1, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def powers(n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 64), _BASE, np.uint64)]), dtype=np.uint64)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of the result depend on all bits of the input."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters, one text at least: bounds the arrays made at once."""
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > limit:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


class Chars:
    """Code points of several texts, each between two line feeds.

    cp: code points; doc_at: where each text begins; n_chars: its length; start, end: of each word; doc: the word's text.
    """

    def __init__(self, texts: list[str]):
        joined = "\n" + "\n".join(texts) + "\n"
        self.cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        self.n_chars = np.fromiter(map(len, texts), np.int64, len(texts))
        self.doc_at = 1 + np.concatenate([[0], np.cumsum(self.n_chars + 1)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
        self.ws = (self.cp == 32) | ((self.cp >= 9) & (self.cp <= 13))
        self.start = np.flatnonzero(self.ws[:-1] & ~self.ws[1:]) + 1
        self.end = np.flatnonzero(~self.ws[:-1] & self.ws[1:]) + 1
        self.doc = np.searchsorted(self.doc_at, self.start, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)

    def word_hashes(self, cp: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, of ``cp`` (for example folded code points) where given."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        cp = self.cp if cp is None else cp
        at = np.arange(self.start[0], len(cp))
        owner = np.repeat(self.start, np.diff(np.append(self.start, len(cp))))
        with np.errstate(over="ignore"):
            value = (cp[self.start[0] :].astype(np.uint64) + np.uint64(1)) * powers(int((at - owner).max()) + 1)[at - owner]
            value[self.ws[self.start[0] :]] = 0
            return mix(np.add.reduceat(value, self.start - self.start[0]))


def fold_ascii(cp: np.ndarray) -> np.ndarray:
    """Lower-case A-Z."""
    return np.where((cp >= 65) & (cp <= 90), cp + 32, cp)


_LOWER: np.ndarray | None = None


def fold(cp: np.ndarray) -> np.ndarray:
    """Lower-case every letter of the basic plane that has a one-character lower case."""
    global _LOWER
    if _LOWER is None:
        _LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x10000)], np.uint32)
    return np.where(cp < 0x10000, _LOWER[np.minimum(cp, 0xFFFF)], cp)
