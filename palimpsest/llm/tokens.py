"""Words of whole texts as numpy arrays.

A block is a run of rows whose texts lie end to end in one byte array. Python sees blocks only, never single
words: boundaries come from byte classes, hashes from eight bytes at a time. A block holds about ``BLOCK`` bytes, or one
text if that is longer, so memory follows the longest text and not the partition.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_LONG = 512  # bytes
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class _Powers(dict):
    """Computed in each worker; travels empty."""

    def __reduce__(self):
        return _Powers, ()


_POWERS = _Powers()

BYTES = np.arange(256)
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
BLANK_BYTES = (BYTES == 32) | ((BYTES >= 9) & (BYTES <= 13))
#: ``[^\x20\x09-\x0D]``: every byte that is not white space; bytes above 127 belong to characters of words.
NOT_BLANK = ~BLANK_BYTES
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, letters and all characters above ASCII.
ALNUM = ((BYTES >= 48) & (BYTES <= 57)) | ((BYTES >= 65) & (BYTES <= 90)) | ((BYTES >= 97) & (BYTES <= 122)) | (BYTES > 127)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < size:
        size = max(size, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _POWERS[name] = np.multiply.accumulate(powers)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def factorize(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value, distinct values in order of first occurrence)."""
    found = pa.array(values).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy()


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Block:
    """Texts end to end: ``data`` bytes, ``bounds`` the first byte of each text and the end."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        raw = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        values = texts.buffers()[2]
        self.data = np.frombuffer(values, np.uint8)[raw[0]:raw[-1]] if values is not None and raw[-1] > raw[0] else np.zeros(0, np.uint8)
        self.bounds = raw - raw[0]
        self.rows = len(texts)

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every maximal run of bytes with ``inside``; runs never cross texts."""
        mask = np.zeros(len(self.data) + 1, bool)
        mask[:-1] = inside[self.data] if len(inside) == 256 else inside
        before = np.zeros(len(mask), bool)
        before[1:] = mask[:-1]
        before[self.bounds[:-1]] = False
        starts = np.flatnonzero(mask & ~before)
        after = np.zeros(len(mask), bool)
        after[:-1] = mask[1:]
        ends = self.bounds[1:] - 1
        after[ends[ends >= 0]] = False
        return starts, np.flatnonzero(mask & ~after) + 1

    def prefix_hash(self, data: np.ndarray | None = None) -> np.ndarray:
        data = self.data if data is None else data
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data) + 1)[0][:len(data)], out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span: equal bytes, equal hash, wherever they stand. For spans of some hundred bytes."""
        h = (prefix[ends] - prefix[starts]) * _powers(len(prefix))[1][starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of the bytes of each span, eight at a time through a mixer; long spans by BLAKE2."""
        data = self.data if data is None else data
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        n = ends - starts
        h = mix(n.astype(np.uint64) + np.uint64(_BASE))
        open_, done = np.flatnonzero((n > 0) & (n <= _LONG)), 0
        while len(open_):
            left = n[open_] - done
            part = eight[starts[open_] + done] & _MASKS[np.minimum(left, 8)]
            h[open_] = mix((h[open_] ^ part) * np.uint64(0xD6E8FEB86659FD93))
            open_, done = open_[left > 8], done + 8
        for i in np.flatnonzero(n > _LONG):
            h[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
        return h

    def owner(self, starts: np.ndarray) -> np.ndarray:
        """The text in which each position lies."""
        return np.searchsorted(self.bounds[1:], starts, side="right")

    def words(self, inside: np.ndarray = NOT_BLANK, lower: bool = True):
        """(starts, ends, hashes, first word of each text and the number of words)."""
        starts, ends = self.spans(inside)
        return starts, ends, self.word_hashes(starts, ends, LOWER[self.data] if lower else None), np.searchsorted(starts, self.bounds)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values; run i starts at value i."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += h[i:i + n]
    return mix(out)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Cut Arrow batches into blocks of about ``most`` bytes of ``column``; empty batches give nothing."""
    try:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            size = texts.cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(size.buffers()[1], np.int64)[size.offset:size.offset + len(size) + 1]
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
                last = min(max(last, first + 1), batch.num_rows)
                part = batch.slice(first, last - first)
                yield part, Block(size.slice(first, last - first))
                first = last
    finally:
        give_back()


def binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value per interval of ``cuts`` over ``values``: the raw little-endian items."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(cuts, np.int64) * values.itemsize)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())
