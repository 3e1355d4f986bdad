"""Words and shingles of whole Arrow text columns as numpy arrays, without a Python step per word.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``). Words and word sequences are
compared by hashes: a polynomial over the bytes (or word hashes) modulo 2**64, followed by a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

# Bytes of text handled at a time; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(size: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[which]
    tables = []
    for factor in (base, pow(base, -1, 1 << 64)):
        table = np.full(size, factor & _MASK, np.uint64)
        table[0] = 1
        tables.append(np.multiply.accumulate(table))
    return tables[0], tables[1]


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least ``n`` of each."""
    size = 1 << 16
    while size < n:
        size *= 2
    return _powers(size, which)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span; equal content gives equal hashes wherever it stands."""
    up, down = powers(len(values) + 1, which)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


class Texts:
    """A run of documents: their bytes, and the rows they came from."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int):
        self.data, self.offsets, self.first_row, self.n = data, offsets, first_row, len(offsets) - 1

    def words(self) -> None:
        """Find the words: ``starts``, ``ends``, ``doc`` of each, and ``first``: words before each document."""
        n = len(self.data)
        inside = np.zeros(n + 1, bool)
        np.logical_not(SPACE[self.data], out=inside[:n])
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[: n - 1] if n else False
        self.starts = np.flatnonzero(inside[:n] & (~before | edge[:n]))
        self.ends = np.flatnonzero(inside[:n] & (~inside[1:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))

    def word_hashes(self, which: int = 0) -> np.ndarray:
        return spans_hash(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, which)

    def windows(self, hashes: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``size`` words inside one document."""
        at = np.arange(max(0, len(hashes) - size + 1))
        at = at[self.doc[at] == self.doc[at + size - 1]]
        return at, spans_hash(hashes, at, at + size, which)

    def kept_text(self, removed: np.ndarray) -> pa.Array:
        """The words that are not ``removed``, joined by one space."""
        kept = np.flatnonzero(~removed)
        doc = self.doc[kept]
        opening = np.ones(len(kept), bool)
        opening[1:] = doc[1:] != doc[:-1]
        change = np.zeros(len(self.data) + 1, np.int8)
        later = kept[~opening]
        np.add.at(change, self.starts[later] - 1, 1)
        np.add.at(change, self.starts[kept[opening]], 1)
        np.add.at(change, self.ends[kept], -1)
        mask = np.cumsum(change[:-1], dtype=np.int8) > 0
        data = self.data.copy()
        data[self.starts[later] - 1] = 0x20
        sizes = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[self.offsets]
        return pa.LargeStringArray.from_buffers(self.n, pa.py_buffer(sizes), pa.py_buffer(data[mask]))


def pieces(column: pa.Array, lower: bool = False, size: int = PIECE_BYTES) -> Iterator[Texts]:
    """The documents of a text (or UTF-8 binary) column in pieces of about ``size`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    else:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        part = data[offsets[at] : offsets[end]]
        yield Texts(LOWER[part] if lower else part, offsets[at : end + 1] - offsets[at], at)
        at = end


def pack(column: pa.Array) -> pa.Array:
    """Compress each text on its own; null stays null."""
    press = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
    values = column.cast(pa.large_binary()).to_pylist()
    return pa.array([None if v is None else press(v) for v in values], pa.binary())


def unpack(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts of ``pack`` as UTF-8 binary values."""
    expand = zstandard.ZstdDecompressor().decompress
    return pa.array([None if v is None else expand(v) for v in column.to_pylist()], pa.large_binary())


def batches(rows: pa.Table, limit: int = 1 << 25) -> Iterator[pa.Table]:
    """A table in runs of rows whose packed bytes stay near ``limit``, at least one row each."""
    step = max(1, int(len(rows) * limit / max(1, rows.nbytes)))
    for at in range(0, len(rows), step):
        yield rows.slice(at, step)
