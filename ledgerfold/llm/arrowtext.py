"""Vectorised work on the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that one step of vectorised work holds at once (one longer text goes alone).
STEP_BYTES = 1024 * 1024

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows for mapInArrow, giving memory back at the end of a partition: workers live on for other stages."""

    @functools.wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return run


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to larger ones of about `most` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and their offsets (one more than texts); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about equal bytes, at most `most` unless one text is longer."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes, so all of any longer UTF-8 sequence, stay."""
    return np.frombuffer(data.tobytes().lower(), np.uint8)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each white-space separated word, and the words' offsets by text.

    White space is 0x20 and 0x09-0x0D. Words are put in an Arrow dictionary
    first, so each distinct word is hashed once.
    """
    space = _SPACE[data]
    inside = ~space
    first = inside.copy()
    if len(data):
        first[1:] &= space[:-1]
        ends = offsets[1:-1]
        ends = ends[ends < len(data)]
        first[ends] |= inside[ends]  # a text starts a new word
    starts = np.flatnonzero(first)
    kept_before = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    word_offsets = np.concatenate((kept_before[starts], [kept_before[-1]])).astype(np.int64)
    packed = np.ascontiguousarray(data[inside])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(word_offsets), pa.py_buffer(packed)]
    ).dictionary_encode()
    distinct = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary)
    )
    hashes = distinct[words.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each white-space separated word its first byte, the byte after it and a code that equal words share; and the words' offsets by text."""
    space = _SPACE[data]
    inside = ~space
    begins, over = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= space[:-1]
        texts = offsets[1:-1]
        texts = texts[texts < len(data)]
        begins[texts] |= inside[texts]  # a text starts a new word
        over[:-1] &= space[1:] | begins[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(over) + 1
    packed = np.ascontiguousarray(data[inside])
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)])
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return starts, ends, codes, np.searchsorted(starts, offsets)
