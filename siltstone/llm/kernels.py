"""Vectorised text kernels used inside Spark tasks.

Every function works on one Arrow batch of strings that Spark hands to a task;
nothing here starts jobs or keeps state between batches.
"""

from __future__ import annotations

import numpy as np

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x += _GOLD
        x ^= x >> np.uint64(30)
        x *= _MIX1
        x ^= x >> np.uint64(27)
        x *= _MIX2
        x ^= x >> np.uint64(31)
    return x


_pow_cache: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the largest n asked so far."""
    have = _pow_cache.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 1 << 16), np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            have = np.cumprod(steps, dtype=np.uint64)
        _pow_cache[base] = have
    return have[:n]


class PrefixHash:
    """Hash of any substring of a code-point array in O(1) each, vectorised."""

    def __init__(self, points: np.ndarray):
        with np.errstate(over="ignore"):
            n = len(points)
            self.sum = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(mix64(points) * _powers(_BASE_INV, n), out=self.sum[1:])
            self.scale = _powers(_BASE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sum[end] - self.sum[start]) * self.scale[start])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _classes() -> np.ndarray:
    """0 white space, 1 word character, 2 any other, for every BMP code point."""
    table = np.full(1 << 16, 2, dtype=np.uint8)
    for c in range(1 << 16):
        if chr(c).isspace():
            table[c] = 0
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_":
        table[ord(c)] = 1
    return table


_CLASS: np.ndarray | None = None


def char_classes(points: np.ndarray) -> np.ndarray:
    global _CLASS
    if _CLASS is None:
        _CLASS = _classes()
    return _CLASS[np.minimum(points, 0xFFFF)]


def batches_by_chars(lengths: np.ndarray, most: int = 1_500_000):
    """Slices of consecutive texts whose characters together stay near `most`."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many texts: (text index, 64-bit hash) of each, in order.

    A token is a maximal run of ``[A-Za-z0-9_]`` or any other single character
    that is not white space.
    """
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    docs, hashes = [], []
    for a, b in batches_by_chars(lengths):
        points = code_points("\n".join(texts[a:b]) + "\n")
        kind = char_classes(points)
        word = kind == 1
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        start = np.flatnonzero((kind == 2) | (word & ~before))
        after = np.empty_like(word)
        after[-1] = False
        after[:-1] = word[1:]
        end = np.flatnonzero((kind == 2) | (word & ~after)) + 1
        hashes.append(PrefixHash(points).of(start, end))
        bounds = np.cumsum(lengths[a:b] + 1)
        docs.append(np.searchsorted(bounds, start, side="right") + a)
    if not docs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(docs), np.concatenate(hashes)


def shingle_hashes(docs: np.ndarray, tokens: np.ndarray, width: int = 5):
    """Hashes of runs of `width` tokens within one text: (text index, hash)."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    scale = _powers(_BASE, width)
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            h += tokens[k : k + n] * scale[k]
    same = docs[:n] == docs[width - 1 :]
    return docs[:n][same], mix64(h[same])


def distinct_per_text(docs: np.ndarray, hashes: np.ndarray):
    """Distinct (text, hash) pairs, sorted by text then hash."""
    if not len(docs):
        return docs, hashes
    order = np.lexsort((hashes, docs))
    d, h = docs[order], hashes[order]
    keep = np.ones(len(d), dtype=bool)
    keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[keep], h[keep]
