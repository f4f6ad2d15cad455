"""Words of many texts at once, as arrays over their UTF-8 bytes.

No Python object is made per word: a column's buffer is cut by table look-ups, and each
word gets a 64-bit polynomial hash by which equal words are told from others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers of an odd number modulo 2^64."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * len(_powers)), _BASE)]), dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``data``: bytes of all texts; ``bounds``: where each text begins, and the end;
    ``start``/``end``: of each word; ``owner``: its text; ``lengths``: words of each text."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    lengths: np.ndarray

    def hashes(self) -> np.ndarray:
        return hashes(self.data, self.start, self.end)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        at = np.flatnonzero(flags)
        return np.diff(np.searchsorted(at, self.bounds)).astype(np.int64)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs, which don't overlap, ascend and aren't empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    sizes = end - start
    first = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(first, sizes)
    letters = data[np.repeat(start, sizes) + inside]
    terms = (letters.astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()))[inside]
    return mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its texts; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(column: pa.Array, table: np.ndarray | None = None) -> Words:
    """Runs of bytes other than ASCII white space, of every text of a string column; each
    byte is first replaced by ``table``'s entry."""
    data, bounds = column_bytes(column)
    if table is not None:
        data = table[data]
    solid = ~SPACES[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    # A text's first and last byte end a word even where its neighbour text has no space.
    edges = bounds[:-1][np.diff(bounds) > 0]
    begins[edges] |= solid[edges]
    last = bounds[1:][np.diff(bounds) > 0] - 1
    stops[last] |= solid[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    lengths = np.diff(np.searchsorted(start, bounds)).astype(np.int64)
    return Words(data, bounds, start, end, np.repeat(np.arange(len(lengths)), lengths), lengths)


def cuts(column: pa.Array, budget: int = 1_000_000):
    """(from, to) runs of texts with about ``budget`` bytes, one text at least."""
    _, bounds = column_bytes(column)
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + budget, "right")) - 1)
        yield a, min(b, n)
        a = b
