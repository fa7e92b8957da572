"""Compact levels of an n-gram trie: Elias-Fano sequences in memory maps."""

from __future__ import annotations

import mmap

import numpy as np

BLOCK = 1 << 15  # values decoded at once while searching


class Mapped:
    """Arrays kept in memory maps of their own, outside the heap and without a file on the machine; each goes with its array."""

    def put(self, array: np.ndarray) -> np.ndarray:
        if not array.size:
            return array
        held = mmap.mmap(-1, array.nbytes)
        held[:] = array.tobytes()
        return np.frombuffer(held, array.dtype)


class EliasFano:
    """A nondecreasing sequence of nonnegative integers: low halves as they are, high halves in unary.

    The first value of every block is kept beside it, so a search decodes only blocks it can end in.
    """

    def __init__(self, values: np.ndarray, store: Mapped) -> None:
        values = np.asarray(values, np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        spread = max(1, top // max(1, self.n))
        self.low_bits = 8 if spread < 1 << 12 else 16 if spread < 1 << 20 else 32
        low = {8: np.uint8, 16: np.uint16, 32: np.uint32}[self.low_bits]
        self.low = store.put((values & np.uint64((1 << self.low_bits) - 1)).astype(low))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.heads = values[::BLOCK].copy()
        self.high_heads = high[::BLOCK].copy()
        self.bits = []
        for at in range(0, self.n, BLOCK):
            part = high[at : at + BLOCK] - high[at]
            unary = np.zeros(int(part[-1]) + len(part), np.uint8)
            unary[part + np.arange(len(part))] = 1
            self.bits.append(store.put(np.packbits(unary)))

    def block(self, i: int) -> np.ndarray:
        n = min(BLOCK, self.n - i * BLOCK)
        ones = np.flatnonzero(np.unpackbits(self.bits[i]))[:n]
        high = (ones - np.arange(n) + self.high_heads[i]).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self.low[i * BLOCK : i * BLOCK + n].astype(np.uint64)

    def successor(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending queries: the index of the first value that is not smaller, and whether it is equal."""
        queries = np.asarray(queries, np.uint64)
        at = np.full(len(queries), self.n, np.int64)
        hit = np.zeros(len(queries), bool)
        cut = np.append(np.searchsorted(queries, self.heads, "left"), len(queries))
        at[: cut[0]] = 0
        for i in range(len(self.heads)):
            a, b = cut[i], cut[i + 1]
            if a == b:
                continue
            values = self.block(i)
            place = np.searchsorted(values, queries[a:b], "left")
            inside = place < len(values)
            hit[a:b][inside] = values[place[inside]] == queries[a:b][inside]
            at[a:b] = i * BLOCK + place
        return at, hit


class NgramTrie:
    """Word sequences read backwards, last word first, with quantised log10 numbers at every level.

    Level one holds the last words, level two the word before within each, level three the word
    before that. Level n's rising sequence stores each entry as its parent's rank times the number
    of ids plus its own id, so a search is relative to the parent found one level up; the pointers
    say where each parent's entries begin. Every level holds the smoothed numerator of a sequence
    that is known so far and no further; levels one and two also the denominator of the words that follow.
    """

    STEP = 1 / 2048  # of a stored log10 number
    LEAST = -16.0

    def __init__(self, levels: list[tuple[np.ndarray, ...]], ids: int) -> None:
        """levels[n]: (parent rank, id, numbers ...) of entries ascending by parent and id; level one has parent 0."""
        store = Mapped()
        self.ids = np.uint64(ids)
        self.entries, self.pointers, self.numbers = [], [], []
        for n, (parent, word, *numbers) in enumerate(levels):
            self.entries.append(EliasFano(parent.astype(np.uint64) * self.ids + word.astype(np.uint64), store))
            if n:
                above = len(levels[n - 1][0])
                self.pointers.append(EliasFano(np.searchsorted(parent, np.arange(above + 1)), store))
            self.numbers.append([store.put(self._stored(x)) for x in numbers])

    def _stored(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.LEAST) / self.STEP), 0, 65535).astype(np.uint16)

    def number(self, level: int, which: int, at: np.ndarray) -> np.ndarray:
        return self.numbers[level][which][at].astype(np.float64) * self.STEP + self.LEAST

    def find(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each (parent, word) in a level, -1 where it is not there or has no parent; queries ascend."""
        out = np.full(len(word), -1, np.int64)
        known = np.flatnonzero(parent >= 0)
        at, hit = self.entries[level].successor(parent[known].astype(np.uint64) * self.ids + word[known].astype(np.uint64))
        out[known[hit]] = at[hit]
        return out
