"""Words, word n-grams and MinHash values of whole batches of UTF-8 text, vectorised in numpy.

A word is a maximal run of ASCII letters and digits and of non-ASCII characters; callers
lower-case texts first. A text of fewer than ``n`` words but at least one has one n-gram, all its
words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SLAB = 1 << 19

#: Bytes that belong to words, after lower-casing.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

_powers = np.ones(1, U64)
_inverse_powers = np.ones(1, U64)


def _need_powers(n: int) -> None:
    global _powers, _inverse_powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, _BASE)]), dtype=U64)
        _inverse_powers = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, _BASE_INVERSE)]), dtype=U64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), so that near values become unrelated."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts (one entry more)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def row_slices(rows: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of at most ``most`` bytes each, or of one row."""
    lo = 0
    while lo < len(rows) - 1:
        hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans do not overlap and ascend."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLAB, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        _need_powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * _powers[: hi - lo], out=total[1:])
        out[i:j] = (total[ends[i:j] - lo] - total[starts[i:j] - lo]) * _inverse_powers[starts[i:j] - lo]
        i = j
    return mixed(out)


def word_hashes(data: np.ndarray, rows: np.ndarray, word_bytes: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where each row's words start (one entry more)."""
    hashes, starts, _ = word_spans(data, rows, word_bytes)
    return hashes, np.searchsorted(starts, rows).astype(np.int64)


def word_spans(data: np.ndarray, rows: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the bytes at which it starts and ends."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word_bytes[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    cut = rows[(rows < len(data))]
    joined = before[:-1].copy()
    joined[cut] = False
    starts = np.flatnonzero(inside & ~joined)
    after = np.empty(len(data), bool)
    after[:-1] = inside[1:]
    after[-1] = False
    last = cut[cut > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return span_hashes(data, starts, ends), starts, ends


def ngram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each n-gram in order (repeats stay), and where each row's start."""
    weights = [mixed(np.array([i + 1], U64))[0] | U64(1) for i in range(n + 1)]
    count = np.diff(rows)
    short = (count > 0) & (count < n)
    made = np.where(count >= n, count - n + 1, short.astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    first = np.repeat(rows[:-1] - at[:-1], made) + np.arange(at[-1])
    padded = np.concatenate([words, np.zeros(n, U64)])
    out = np.zeros(at[-1], U64)
    for k in range(n):
        out += padded[first + k] * weights[k]
    for r in np.flatnonzero(short):
        own = words[rows[r] : rows[r + 1]]
        terms = np.append(own * np.array(weights[: len(own)]), np.array([weights[n]]) * U64(len(own)))
        out[at[r]] = terms.sum(dtype=U64)
    return mixed(out), at


def sequence_keys(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's word sequence; equal sequences get equal keys."""
    count = np.diff(rows)
    place = (np.arange(len(words)) - np.repeat(rows[:-1], count)).astype(U64)
    one = np.zeros(len(words) + 1, U64)
    two = np.zeros(len(words) + 1, U64)
    np.cumsum(mixed(words + mixed(place)), out=one[1:])
    np.cumsum(mixed(words * U64(3) + mixed(place + U64(1 << 40))), out=two[1:])
    length = count.astype(U64)
    return mixed(one[rows[1:]] - one[rows[:-1]] + length), mixed(two[rows[1:]] - two[rows[:-1]] + length)


class Permutations:
    """``count`` universal hash functions h(x) = (a*x + b mod 2^64) >> 32, fixed by ``seed``."""

    def __init__(self, count: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 1 << 63, count, dtype=U64) * U64(2) + U64(1)
        self.b = draw.integers(0, 1 << 63, count, dtype=U64) * U64(2)

    def minima(self, grams: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """MinHash values, one row of ``count`` uint32 a text; all ones for a text without n-grams."""
        out = np.full((len(rows) - 1, len(self.a)), 0xFFFFFFFF, np.uint32)
        full = np.flatnonzero(np.diff(rows))
        i = 0
        while i < len(full):
            lo = rows[full[i]]
            j = max(i + 1, int(np.searchsorted(rows[full + 1], lo + (_SLAB >> 2), "right")))
            part, starts = grams[lo : rows[full[j - 1] + 1]], rows[full[i:j]] - lo
            for k in range(len(self.a)):
                out[full[i:j], k] = np.minimum.reduceat(((part * self.a[k] + self.b[k]) >> U64(32)).astype(np.uint32), starts)
            i = j
        return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` MinHash values; the band's number is part of it."""
    out = np.empty((len(minima), bands), U64)
    for b in range(bands):
        key = np.full(len(minima), mixed(np.array([b + 1], U64))[0], U64)
        for r in range(rows):
            key = mixed(key + minima[:, b * rows + r].astype(U64))
        out[:, b] = key
    return out


def distinct_sets(grams: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    return [np.unique(grams[rows[i] : rows[i + 1]]) for i in range(len(rows) - 1)]
