"""Byte-level text tools on whole Arrow columns.

Everything here works on one flat byte buffer for a batch of documents, so a word costs a few
array operations rather than a Python object.  Words are maximal runs of bytes other than
``[\\x20\\x09-\\x0D]``; a null text has no words.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Base of the polynomial word hash (any odd number will do) and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_powers: dict[int, np.ndarray] = {}


def release() -> None:
    """Give memory that is free again back to the system, as a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept for the next batch."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have))
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads each value over all 64 bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(values)
    total = np.zeros(n + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(BASE, n), out=total[1:])
    return mix((total[end] - total[start]) * powers(BASE_INVERSE, n + 1)[start] + (end - start).astype(U64))


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each slice values[start:end] that does not depend on where the slice lies.  Starts
    ascend; slices are taken in blocks of about ``BLOCK`` values, which bounds the memory."""
    if len(values) <= 2 * BLOCK:
        return _range_hash(values, start, end)
    out, i = np.empty(len(start), U64), 0
    while i < len(start):
        low = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, low + BLOCK)))
        out[i:j] = _range_hash(values[low : int(end[i:j].max())], start[i:j] - low, end[i:j] - low)
        i = j
    return out


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the len + 1 offsets of the texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_chunk(batches):
    """(chunk, rows) of a stream of batches that is sorted by the column chunk; a chunk is all that is held."""
    held, current = [], None
    for batch in batches:
        chunk = batch.column(batch.schema.get_field_index("chunk")).to_numpy()
        for part in Runs(chunk):
            if held and part[0] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = part[0]
            held.append(batch.slice(part[1].start, part[1].stop - part[1].start))
    if held:
        yield current, pa.Table.from_batches(held)


class Runs:
    """Where the run of each key lies in an array whose equal keys stand together.  It has an entry for
    each key that occurs, so its size does not depend on how many keys there might be."""

    def __init__(self, keys: np.ndarray):
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.begin = np.flatnonzero(new)
        self.key, self.end = keys[self.begin], np.append(self.begin[1:], len(keys))[: len(self.begin)]

    def __iter__(self):
        return ((k, slice(a, b)) for k, a, b in zip(self.key.tolist(), self.begin.tolist(), self.end.tolist()))

    def __getitem__(self, key: int) -> slice:
        """The run of a key of an ascending array."""
        i = int(np.searchsorted(self.key, key))
        return slice(int(self.begin[i]), int(self.end[i]))


def in_order(table: pa.Table) -> pa.Table:
    """The rows by id (nulls last) and text.  Rows reach a task in any order, and what two passes over
    a chunk number alike must not depend on it."""
    return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_end"))


@dataclass
class Words:
    """The words of a batch.  ``data`` holds them in order, each followed by one space; word i is
    ``data[start[i]:end[i]]``; text d has the words ``first[d]`` to ``first[d + 1] - 1``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return range_hash(self.data, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words_of(column, lower: bool = False) -> Words:
    data, offsets = flat_bytes(column)
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    if n:
        before[1:] = ~solid[:-1]
        after[:-1] = ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:n]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    size = end - start
    to = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=to[1:])
    out = np.full(to[-1], 0x20, np.uint8)
    letters = np.ones(to[-1], bool)
    letters[to[1:] - 1] = False
    kept = data[solid]
    out[letters] = _LOWER[kept] if lower else kept
    return Words(out, to[:-1], to[1:] - 1, first)


def as_binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Consecutive slices of one buffer as an Arrow binary array, without copying."""
    offsets = np.ascontiguousarray(offsets, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
