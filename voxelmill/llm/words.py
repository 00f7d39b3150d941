"""Vectorised words of UTF-8 text: boundaries and hashes of words, prefixes and shingles in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, np.uint64(base)
    while have < n:
        m = min(have, n - have)
        out[have : have + m] = out[:m] * step
        step = np.uint64(pow(base, 2 * have, 1 << 64))
        have += m
    return out


class Powers:
    """The powers of BASE and of its inverse, as long as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(2 * n), powers(2 * n, INVERSE)
        return self.up, self.down

    def __reduce__(self):
        return (type(self), ())


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def folded() -> np.ndarray:
    """Byte table: A-Z lowered, ASCII letters, digits and bytes from 128 kept, others 0."""
    t = np.zeros(256, np.uint8)
    for c in range(256):
        if c >= 128 or chr(c).isalnum():
            t[c] = ord(chr(c).lower()) if c < 128 else c
    return t


FOLD = folded()


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes; start, end and row of each word, a run of ASCII letters, digits or non-ASCII bytes.

    A capital of the Latin-1 letters (two bytes from C3 80) is lowered as well. Words end where rows do.
    """
    b = FOLD[data]
    if len(b) > 1:
        at = np.flatnonzero(b[:-1] == 0xC3) + 1
        up = at[(b[at] >= 0x80) & (b[at] <= 0x9E) & (b[at] != 0x97)]
        b[up] += 0x20
    inside = np.zeros(len(b) + 1, bool)
    inside[:-1] = b != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = off[1:-1]
    begins[edge] |= inside[edge]
    ends = np.zeros(len(b) + 1, bool)
    ends[1:] = inside[:-1] & ~inside[1:]
    ends[edge[edge > 0]] |= inside[edge[edge > 0] - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends)
    return b, s, e, np.searchsorted(off, s, "right") - 1


#: Bytes of one text that are hashed at a time.
PIECE = 1 << 20


def pieces(data: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Byte ranges of about `most` bytes that cover a text and end at no word's inside; longer where a word is."""
    lo = 0
    while lo < len(data):
        hi = lo + most
        while hi < len(data) and not (gap := np.flatnonzero(FOLD[data[hi : hi + most]] == 0)).size:
            hi += most
        hi = min(hi + int(gap[0]), len(data)) if hi < len(data) else len(data)
        yield lo, hi
        lo = hi


def hashed_words(data: np.ndarray, off: np.ndarray, pw: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word; a text beyond PIECE is dealt with piece by piece."""

    def hashed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, s, e, row = word_spans(data, off)
        return span_hash(prefix_sums(b, pw), s, e, pw), row

    if len(off) == 2 and len(data) > 2 * PIECE:
        each = [hashed(data[a:z], np.array([0, z - a])) for a, z in pieces(data)]
        return np.concatenate([h for h, _ in each]), np.concatenate([r for _, r in each])
    return hashed(data, off)


def prefix_sums(b: np.ndarray, pw: Powers) -> np.ndarray:
    up, _ = pw.get(len(b) + 1)
    h = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=h[1:])
    return h


def span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray, pw: Powers) -> np.ndarray:
    """64-bit hashes of the spans s..e of the bytes whose prefix sums are h."""
    _, down = pw.get(len(h))
    return mix((h[e] - h[s]) * down[s])


def shingles(word_hash: np.ndarray, row: np.ndarray, n: int, pw: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of n words in a row; a row of fewer words has all of them as its one shingle."""
    if not len(word_hash):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = pw.get(len(word_hash) + 1)
    h = np.zeros(len(word_hash) + 1, np.uint64)
    np.cumsum(word_hash * up[: len(word_hash)], out=h[1:])
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    last = np.append(first[1:], len(row))  # past the end of each row's words
    stop = np.repeat(last, last - first)
    at = np.arange(len(row))
    starts = np.flatnonzero((at + n <= stop) | (at == np.repeat(first, last - first)))
    ends = np.minimum(starts + n, stop[starts])
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64)), row[starts]
