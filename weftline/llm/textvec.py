"""Words and their hashes over Arrow buffers, without a Python object per word.

A batch of texts is one array of UTF-8 bytes with offsets. Words are found by a table of 256 flags; a word's 64-bit hash
is a difference of prefix sums of a polynomial in an odd base, mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flags(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to words: all but the ranges given, both ends included."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


#: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in UTF-8, where bytes from 0x80 are never white space or punctuation.
NOT_SPACE = flags((0x20, 0x20), (0x09, 0x0D))
ALNUM = flags((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of the base, and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads each bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets from 0) of runs of whole texts of about ``most`` bytes together; a longer text is a run alone. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, width)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def release() -> None:
    """Gives memory that is no longer used back to the system, so that a worker between batches is small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


class Words:
    """The words of a run of texts.

    start, end: bytes of each word; first: for each text, and at the end, the number of words before it; hash: mixed
    64-bit hash of each word.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, is_word: np.ndarray, lower: bool = True):
        self.bytes = LOWER[data] if lower else data
        inside = is_word[self.bytes]
        n = len(inside)
        bounds = offs[:-1][offs[:-1] < n]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[bounds] = inside[bounds]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = offs[1:][offs[1:] > 0] - 1
        ends[last] = inside[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            n = len(self.bytes)
            size = 1 << max(18, (n + 1).bit_length())
            up, down = _powers(size)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.bytes] * up[:n], out=sums[1:])
            self._hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        return self._hash

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k values from each position on; the last k - 1 positions are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): the distinct shingles of all texts, sorted within each, and where each text's begin. A text of fewer than k words, but not none, has its whole sequence as one."""
    starts, count = words.first[:-1], words.count
    per = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    cut = np.concatenate([[0], np.cumsum(per)])
    hashes = np.zeros(cut[-1], np.uint64)
    full = np.repeat(count >= k, per)
    at = np.repeat(starts - cut[:-1], per) + np.arange(cut[-1])
    if full.any():
        hashes[full] = runs(words.hash, k)[at[full]]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            own[has] = own[has] * np.uint64(0xD6E8FEB86659FD93) + words.hash[starts[short[has]] + j]
        hashes[cut[short]] = mix(own + count[short].astype(np.uint64))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[cut[:-1][cut[:-1] < len(hashes)]] = True
    return np.concatenate([[0], np.cumsum(new)])[cut], hashes[new]
