"""Vectorised text kernels that work on whole Arrow string columns.

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D], with A-Z lower-cased.
Nothing here runs once per word in Python, so the cost is a few passes of numpy over
the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: An odd multiplier and its inverse modulo 2**64, so that windows of a prefix sum can be shifted back.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work over batches, after which the process gives back what it no longer uses: Spark keeps it for later tasks."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return leaner


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for consecutive rows of about `most` bytes; a longer text is a slice of its own."""
    data, at = buffer(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, at: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of the rows that begin at `at`; letters: of each run of ASCII letters, digits and bytes beyond ASCII."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = _LETTER[data] if letters else ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = at[(at > 0) & (at < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def word_counts(texts: pa.Array) -> np.ndarray:
    """Number of words of each row."""
    out = np.zeros(len(texts), np.int64)
    for i, data, at in slices(texts):
        rows = words(data, at)[2]
        out[i : i + len(at) - 1] = np.bincount(rows, minlength=len(at) - 1)
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 hash of each data[start:end]."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, at: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each lower-cased word."""
    starts, ends, rows = words(data, at, letters)
    return span_hashes(lowered(data), starts, ends), rows


def hash_word(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(lowered(data), np.array([0]), np.array([len(data)]))[0])


def shingle_hashes(h: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of k words; a row with 1 to k - 1 words gives one shingle of all of them."""
    n = len(h)
    count = np.bincount(rows, minlength=n_rows)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        m = n - j
        if m > 0:
            part = h[j:] * np.uint64((2 * j + 3) * 0x9E3779B97F4A7C15 % (1 << 64) | 1)
            part = np.where(rows[j:] == rows[:m], part, np.uint64(0))
            acc[:m] += mix(part + np.uint64(j))
    first = np.zeros(n, bool)
    full = np.zeros(n, bool)
    if n:
        first[0] = True
        first[1:] = rows[1:] != rows[:-1]
        if n >= k:
            full[: n - k + 1] = rows[k - 1 :] == rows[: n - k + 1]
    keep = full | (first & (count[rows] < k))
    return mix(acc[keep]), rows[keep]
