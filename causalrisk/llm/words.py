"""Words of many texts at once: byte-level tokenising and hashing of Arrow string columns.

The texts of a column lie one after the other in one buffer, so word borders,
lower-casing and hashes are whole-array operations; no text is handled alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts handled at once, in bytes, so that their arrays stay in cache; one longer text is handled alone.
CHUNK_BYTES = 250_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table over the 256 byte values: True inside the ranges (both ends included)."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: `[^\x20\x09-\x0D]+`: every byte but ASCII white space. All bytes of a multi-byte character belong to words.
NOT_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a to z, and all that is not ASCII.
ALNUM = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


@dataclass
class Words:
    """Words of a run of texts. `text` is the number of the word's text; words of a text are neighbours."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # per text: index of its first word; one more entry closes the last text
    bytes: np.ndarray  # lower-cased unless asked otherwise
    offsets: np.ndarray  # per text: its first byte; one more entry closes the last text

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, from all its bytes."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        total = _BYTE_VALUE[self.bytes]
        total *= _powers(_BASE, len(total))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(total, dtype=np.uint64)])
        value = (total[self.end] - total[self.start]) * _powers(_UNBASE, len(self.bytes) + 1)[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64))


def words_of(buffer: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True) -> Words:
    """Words of the texts that `offsets` cuts out of a byte buffer."""
    begin, stop = int(offsets[0]), int(offsets[-1])
    data = _LOWER[buffer[begin:stop]] if lower else buffer[begin:stop]
    offsets = offsets.astype(np.int64) - begin
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = table[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    cut = offsets[1:-1]
    fresh = inside & ~before
    fresh[cut] = inside[cut]  # a word never goes on into the next text
    start = np.flatnonzero(fresh)
    closed = before & ~inside
    closed[cut] |= before[cut]
    end = np.flatnonzero(closed)
    text = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets, side="left")
    return Words(start, end, text, first, data, offsets)


def text_chunks(column: pa.Array | pa.ChunkedArray, table: np.ndarray, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of runs of rows of at most CHUNK_BYTES; null texts have no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    buffer = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(offsets, int(offsets[row]) + CHUNK_BYTES, side="right")) - 1
        last = min(n, max(last, row + 1))
        yield row, last, words_of(buffer, offsets[row : last + 1], table, lower)
        row = last


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; n - 1 places fewer than words."""
    size = len(word_hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        total += mix(word_hashes[k : k + size] + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        total *= np.uint64(0xA0761D6478BD642F)
    return mix(total)


def rolling_hashes(word_hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """As gram_hashes, but at the same cost for every n; different seeds give independent hashes."""
    size = len(word_hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    value = mix(word_hashes + np.uint64(seed)) if seed else word_hashes
    total = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(value * _powers(_BASE, len(value)), out=total[1:])
    return mix((total[n:] - total[:-n]) * _powers(_UNBASE, size))
