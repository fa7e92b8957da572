"""Words and rolling hashes of whole texts, vectorised over the byte buffers of Arrow batches.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes are 64-bit polynomial
hashes finished by an avalanche mix; they depend on the text alone, never on the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # text bytes handled at once, so memory does not follow the batch size

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply avalanche) over an array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, b in (("p", _BASE), ("q", inverse)):
            table = np.full(max(n, SLICE_BYTES + 1024), b, np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["p"][:n], _powers["q"][:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each range; equal contents give equal hashes wherever they lie."""
    p, q = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * q[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Slice:
    """Consecutive rows: their bytes end to end, and where each row's bytes begin."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into runs of rows of about `most` bytes (one longer row stays whole). Null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if n == 0:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield Slice(slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """All words of a slice in order: byte ranges, hashes, and each row's range of words."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # row i has words bounds[i]:bounds[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_ranges(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds) of the words of a slice."""
    if len(part.data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(part.offsets), np.int64)
    word = ~_SPACE[part.data]
    first = np.zeros(len(part.data) + 1, bool)
    first[part.offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:-1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, part.offsets)


def words(part: Slice, lower: bool = False) -> Words:
    at, to, bounds = word_ranges(part)
    data = lowered(part.data) if lower else part.data
    hashes = range_hashes(data, at, to) if len(at) else np.zeros(0, np.uint64)
    return Words(at, to, hashes, bounds)


def window_starts(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all k-word windows inside one row, and the bounds of each row's windows."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    out = np.zeros(len(bounds), np.int64)
    np.cumsum(counts, out=out[1:])
    total = int(out[-1])
    return np.arange(total) - np.repeat(out[:-1], counts) + np.repeat(bounds[:-1], counts), out
