"""Ragged numpy arrays over Arrow string columns: text bytes, words, chunks and gathers without Python loops over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z; other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITION_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are hashed at a time.
_BLOCK = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_bytes`` of text each; a longer text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, what = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8)[offsets[0] : offsets[-1]] if what is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row, or runs of bytes that are not ``outside``: their bytes back to back, word offsets into them, and row offsets into the words."""
    solid = ~outside[data]
    n = len(data)
    if n == 0:
        return data, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    opens[first] = solid[first]
    starts = np.flatnonzero(opens)
    letters = data[solid]
    closes = solid
    closes[:-1] &= ~solid[1:] | opens[1:]
    sizes = np.flatnonzero(closes) + 1 - starts
    return letters, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _BYTE_CODE) -> np.ndarray:
    """A 64-bit hash of each byte string: a sum of byte codes times powers by position, mixed with the length."""
    lengths = np.diff(offsets)
    total = np.zeros(len(lengths), np.uint64)
    if len(lengths) == 0:
        return total
    powers = np.cumprod(np.full(max(int(lengths.max()), 1), _POSITION_BASE, np.uint64))
    cuts = np.unique(np.append(np.searchsorted(offsets[:-1], np.arange(0, len(data) + 1, _BLOCK)), len(lengths)))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        start, own = offsets[i], lengths[i:j]
        place = np.arange(offsets[j] - start, dtype=np.int64)
        place -= np.repeat(offsets[i:j] - start, own)
        value = powers[place]
        value *= table[data[start : offsets[j]]]
        full = np.flatnonzero(own)
        if len(full):
            total[i + full] = np.add.reduceat(value, offsets[i:j][full] - start)
    return mix(total + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of byte strings and the distinct ones, in order of first appearance."""
    strings = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def gather(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows ``values[offsets[r]:offsets[r + 1]]`` one after another, and their offsets."""
    lengths = np.diff(offsets)[rows]
    ends = np.cumsum(lengths)
    out = np.concatenate([[0], ends]).astype(np.int64)
    at = np.repeat(offsets[:-1][rows] - out[:-1], lengths)
    at += np.arange(len(at), dtype=at.dtype)
    return values[at], out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each ragged row; an empty row has 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


class FlatMap:
    """A fixed map from 64-bit keys to non-negative int32 values, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        values, left, slot = np.asarray(values, np.int32), np.arange(len(keys)), self._slot(keys)
        while len(left):
            _, first = np.unique(slot, return_index=True)
            free = first[self.values[slot[first]] < 0]
            self.keys[slot[free]], self.values[slot[free]] = keys[left[free]], values[left[free]]
            stay = np.ones(len(left), bool)
            stay[free] = False
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 where a key is absent."""
        slot = self._slot(keys)
        out = self.values[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(left):
            slot = (slot[left] + 1) & self.mask if len(slot) != len(left) else (slot + 1) & self.mask
            got = self.values[slot]
            out[left] = got
            wrong = (got >= 0) & (self.keys[slot] != keys[left])
            left, slot = left[wrong], slot[wrong]
        return out
