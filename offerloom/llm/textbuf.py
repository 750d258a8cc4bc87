"""Whole-batch text kernels: words of Arrow string columns as numpy arrays.

The functions here run inside Spark tasks.  A batch of documents becomes one
byte buffer; words, word hashes and n-gram hashes are then array expressions
over that buffer, so that no Python code runs for each word.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` after
lower-casing A-Z.  Hashes are 64 bits wide; they are equal for equal words and
do not depend on process, batch or machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes that one numpy pass takes at a time.
SLICE_BYTES = 1 << 20

_GOLD = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


_libc = ctypes.CDLL(None)


def released() -> None:
    """Give memory that a batch no longer needs back to the machine: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def tidy(f):
    """f of one argument, after which memory goes back to the machine."""

    def run(x):
        out = f(x)
        released()
        return out

    return run


def parts(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about so many bytes of text."""
    at = buffer_of(batch[text])[1]
    for i, j in slices(at, limit):
        yield batch.slice(i, j - i)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * _GOLD)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each; kept for the slices that follow."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, dtype=U64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=U64))
    if n <= 2 * SLICE_BYTES:
        _powers = (made[0], made[1])
    return made[0], made[1]


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of documents first .. first + n_docs - 1 of a batch."""

    first: int
    n_docs: int
    data: np.ndarray  # bytes of the slice, A-Z lower-cased if asked for
    raw: np.ndarray  # the same bytes as they came
    doc_start: np.ndarray  # n_docs + 1 offsets into data
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    doc: np.ndarray  # document of each word, from 0
    hash: np.ndarray  # uint64 of each word
    at: np.ndarray  # n_docs + 1: the first word of each document


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut documents into runs of at most limit bytes; a longer document makes a run alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words_of(column: pa.Array, lower: bool = True, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a string column, slice by slice, in order; every document is in one slice."""
    raw, offsets = buffer_of(column)
    for i, j in slices(offsets, limit):
        piece = raw[offsets[i] : offsets[j]]
        doc_start = offsets[i : j + 1] - offsets[i]
        yield _words(i, _LOWER[piece] if lower else piece, piece, doc_start)


def _words(first: int, data: np.ndarray, raw: np.ndarray, doc_start: np.ndarray) -> Words:
    n = len(data)
    n_docs = len(doc_start) - 1
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = doc_start[:-1][doc_start[:-1] < n]
    opens[heads] = inside[heads]  # a text's first byte opens a word even after another text's word
    start = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tails = doc_start[1:][doc_start[1:] > 0] - 1
    closes[tails] = inside[tails]
    end = np.flatnonzero(closes) + 1
    value = span_hash(data, start, end)
    at = np.searchsorted(start, doc_start)
    doc = np.repeat(np.arange(n_docs), np.diff(at))
    return Words(first, n_docs, data, raw, doc_start, start, end, doc, value, at)


def ngram_hash(value: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of width consecutive values; len(value) - width + 1 of them."""
    n = len(value) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(n, width, dtype=U64) * _GOLD
    for k in range(width):
        out = mix(out ^ value[k : k + n]) + value[k : k + n]
    return out


def windows_inside(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of width-long windows that stay in one document, and the count for each document."""
    n = np.maximum(np.diff(at) - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.repeat(at[:-1], n)
    before = np.concatenate(([0], np.cumsum(n)))[:-1]
    return first + (np.arange(len(doc)) - np.repeat(before, n)), n


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE_VALUE[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64) * _GOLD)


def in_document(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal values of one document."""
    return mix(value ^ mix(doc.astype(U64) * _GOLD + U64(1)))


def per_document(weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of a 0/1 or small integer array over each document's run of positions."""
    total = np.concatenate(([0], np.cumsum(weight, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def hash_strings(column: pa.Array) -> np.ndarray:
    """A 64-bit hash of each whole text, byte for byte."""
    raw, offsets = buffer_of(column)
    out = np.zeros(len(offsets) - 1, dtype=U64)
    for i, j in slices(offsets):
        data, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        out[i:j] = span_hash(data, at[:-1], at[1:])
    return out
