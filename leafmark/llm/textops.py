"""Vectorised text primitives on Arrow buffers, for use inside `mapInArrow`.

A batch of texts is one byte array plus document offsets.  Hashes of any substring
come from one prefix sum (a polynomial hash modulo 2**64 with an odd base, whose
powers are invertible), so words, n-grams and byte windows cost a few numpy passes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that a numpy step works on: its arrays stay near the cache, and a worker's
#: memory is set by this or by its longest document.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}
#: Of the C library, where it has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the worker's next batches."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, (at - at[0] if len(at) else np.zeros(1, np.int64))


def tidy() -> None:
    """Give memory that is free again back to the system: Python workers live on, and what
    they keep from one stage is missing to the next."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pieces(batches: Iterable[pa.RecordBatch], most_bytes: int = PIECE, column: str | int = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most_bytes` of text, or one document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = texts(batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + most_bytes, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
        tidy()


class Hasher:
    """Hashes of substrings [start, end) of one byte array, in any number at once."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) ^ ((end - start).astype(U) * U(0xD6E8FEB86659FD93)))


def owner(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The document that each byte position belongs to."""
    return np.searchsorted(offsets, at, "right") - 1


def tokens(breaks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs without a break, never across documents: starts, ends, documents."""
    n = len(breaks)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = ~breaks
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = breaks[:-1]
    after[:-1] = breaks[1:]
    edges = offsets[1:-1]
    before[edges[edges < n]] = True
    after[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, owner(offsets, starts)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than space, tab and the other ASCII line breaks."""
    return tokens(WHITE[data], offsets)


_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 64, *range(128, 256)]] = True


def sign_breaks(data: np.ndarray) -> np.ndarray:
    """Bytes that are not part of a word: ASCII signs and spaces, and the quotation
    marks, dashes and other signs of the blocks that start with E2 80 and C2."""
    breaks = ~_IN_WORD[data]
    if len(data) > 2:
        sign = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        for k in range(3):
            breaks[sign + k] = True
        sign = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] < 0xC0))
        breaks[sign] = breaks[sign + 1] = True
    return breaks


def counts(docs: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, minlength=n).astype(np.int64)


def by_document(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """An order of `hashes` that keeps documents apart and brings equal hashes together."""
    bits = max(1, int(doc[-1]).bit_length()) if len(doc) else 1
    key = (doc.astype(U) << U(64 - bits)) | (hashes >> U(bits))
    order = np.argsort(key)
    key, ordered = key[order], hashes[order]
    if np.any((key[1:] == key[:-1]) & (ordered[1:] != ordered[:-1])):
        return np.lexsort((hashes, doc))
    return order


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each document of lower-cased words.

    Returns hashes and the offsets of each document's run of them, in ascending order.
    A document of fewer than `size` words has its whole sequence as one shingle; one
    without words has none.
    """
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, doc = words(data, offsets)
    hashes = Hasher(data)(starts, ends)
    many = counts(doc, n)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(many, out=first[1:])
    left = first[doc + 1] - np.arange(len(doc))  # words from here to the document's end
    total = np.zeros(len(doc), U)
    for k in range(size):
        here = hashes[k:] * U((BASE * (2 * k + 3)) % (1 << 64) | 1)
        total[: len(here)] += np.where(left[: len(here)] > k, here, U(0))
    keep = (left >= size) | ((many[doc] < size) & (left == many[doc]))
    total, doc = mix(total + np.minimum(left, size).astype(U))[keep], doc[keep]
    order = by_document(total, doc)
    total, doc = total[order], doc[order]
    fresh = np.ones(len(total), bool)
    fresh[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    total, doc = total[fresh], doc[fresh]
    at = np.zeros(n + 1, np.int64)
    np.cumsum(counts(doc, n), out=at[1:])
    return total, at


def longs(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as the signed longs that Spark stores."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
