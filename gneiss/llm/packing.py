"""Best-fit packing of tokenised documents into sequences of bounded length.

Bulk-synchronous best fit: documents are sorted by length, longest first, and gaps by size. One
sweep places all documents of one length: each gap class from the smallest that still fits upwards
takes as many as its gaps hold, conflicts between documents of that length are settled by rank (the
n-th document takes the n-th place), the gaps are updated, and the next sweep follows.

A length and a gap are at most the capacity, so the state of all sweeps is a table of runs (a range
of sequences with equal gaps) whose size depends on the capacity alone, never on the corpus. The
sweeps run on that table; every document is then placed by its length and its distributed rank in
one join. Ranks come from salted counts, so a length that a third of all documents share is spread.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches, trimmed, written
from .text import Slice, lowered, range_hashes, slices, word_ranges

CACHED_WORDS = 1 << 20  # words whose ids a worker remembers
RANKED = 250_000  # documents of one length that a task ranks, about; the number of salts follows

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of whole texts, for vocabularies in lower case whose tokens never span white space.

    A text's ids are then the ids of its words one after another, so each distinct word is encoded
    once and remembered. A full stop or comma after an ASCII letter or digit is a token of its own
    in these vocabularies and is looked up apart, which leaves fewer distinct words.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if ids("Zebra, don't  stop.") != [i for part in ("zebra", ",", "don't", "stop", ".") for i in ids(part)]:
            raise ValueError(f"{path} is no lower-case vocabulary whose tokens keep within words")
        self._forget()

    def _forget(self) -> None:
        self.row: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.used, self.rows = 0, 0
        self.tails = self._add([".", ","])

    def _add(self, fresh: list[str]) -> np.ndarray:
        # One text of all words: tokens never span white space, so each belongs to the word that holds its last character.
        e = self.tokenizer.encode(" ".join(fresh), add_special_tokens=False)
        more = np.array(e.ids, np.uint32)
        ends = np.fromiter((b for _, b in e.offsets), np.int64, len(more))
        begins = np.cumsum([0] + [len(w) + 1 for w in fresh])
        sizes = np.bincount(np.searchsorted(begins, ends - 1, "right") - 1, minlength=len(fresh))
        while self.used + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(fresh) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used : self.used + len(more)] = more
        self.start[self.rows + 1 : self.rows + len(fresh) + 1] = self.used + np.cumsum(sizes)
        out = np.arange(self.rows, self.rows + len(fresh))
        self.used, self.rows = self.used + len(more), self.rows + len(fresh)
        return out

    def encode(self, part: Slice, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each closed by end_id; bounds of each text)."""
        # A special token's name must not arise from lower-casing: such slices are left as they are.
        plain = b"<|" not in part.data.tobytes()
        data = lowered(part.data) if plain else part.data
        starts, ends, bounds = word_ranges(part)
        tail = np.zeros(len(starts), np.int64)
        if plain and len(starts):
            mark, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
            inner = (ends - starts > 1) & (((before >= 97) & (before <= 122)) | ((before >= 48) & (before <= 57)))
            tail = np.where(inner & (mark == 0x2E), 1, np.where(inner & (mark == 0x2C), 2, 0))
        to = ends - (tail > 0)
        h, first, inverse = np.unique(range_hashes(data, starts, to), return_index=True, return_inverse=True) if len(starts) else (np.zeros(0, np.uint64), starts, starts)
        keys = h.tolist()
        if len(self.row) > CACHED_WORDS:
            self._forget()
        fresh = [i for i, x in enumerate(keys) if x not in self.row]
        if fresh:
            raw = data.tobytes()
            rows = self._add([raw[starts[k] : to[k]].decode() for k in first[fresh]])
            self.row.update(zip([keys[i] for i in fresh], rows.tolist()))
        word = np.array([self.row[x] for x in keys], np.int64)[inverse]
        # In order: each word, its tail if it has one, and after each text a place for end_id.
        row_of = np.repeat(np.arange(len(part)), np.diff(bounds))
        place = np.arange(len(word)) + np.cumsum(tail > 0) - (tail > 0) + row_of
        entry = np.full(len(word) + int((tail > 0).sum()) + len(part), -1, np.int64)
        entry[place] = word
        entry[place[tail > 0] + 1] = self.tails[tail[tail > 0] - 1]
        known = entry >= 0
        size = np.ones(len(entry), np.int64)
        size[known] = (self.start[1:] - self.start[:-1])[entry[known]]
        begin = np.where(known, self.start[np.maximum(entry, 0)], 0)
        edge = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(edge[-1]) + np.repeat(begin - edge[:-1], size)
        ids = self.flat[at]
        stops = np.flatnonzero(~known)
        ids[edge[stops]] = end_id
        return ids.astype("<u4", copy=False), np.concatenate([[0], edge[stops + 1]])


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document cut at `capacity` ids, its end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                ids, bounds = _encoder(tokenizer_path).encode(part, end_id)
                row, piece, length, crc = [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    for j, at in enumerate(range(a, b, capacity)):
                        one = ids[at : min(b, at + capacity)]
                        row.append(i)
                        piece.append(j)
                        length.append(len(one))
                        crc.append(zlib.crc32(one))
                id_ = batch.column(0).slice(part.rows.start, len(part)).take(pa.array(row, pa.int64()))
                piece = np.array(piece, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [id_, pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_sweeps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, last_rank, each, sequence, offset): where the documents of each length go.

    The documents ranked first_rank..last_rank of a length go `each` to a sequence, from `sequence`
    on, the first of each at `offset`.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, how many)
    sizes: list[int] = []  # gaps that have runs, ascending
    opened = 0
    out = []

    def put(gap: int, first: int, many: int) -> None:
        if many and gap:
            if not gaps[gap]:
                sizes.insert(int(np.searchsorted(sizes, gap)), gap)
            gaps[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = int(np.searchsorted(sizes, length))
            if at < len(sizes):
                gap = sizes[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del sizes[at]
            else:
                gap, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            each = gap // length
            full = min(many, left // each)
            if full:
                out.append((length, rank, rank + full * each - 1, each, first, capacity - gap))
                put(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < many and left and left < each:
                out.append((length, rank, rank + left - 1, left, first + full, capacity - gap))
                put(gap - left * length, first + full, 1)
                full, left = full + 1, 0
            put(gap, first + full, many - full)
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into as few sequences of at most `capacity` token ids as best fit finds.

    A document is the ids of its whole text (null: none) and then id 0, so an empty text has one id.
    Only documents longer than capacity are cut. Returns (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset), one row for each piece of each input row; in a sequence the pieces lie end
    to end from offset 0. Rows that repeat an id, or have none, are packed like any other. An empty
    table gives no rows. Other columns are ignored. ids_crc32 is over little-endian unsigned 32-bit ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(tokenised_pieces(source, tokenizer_path, capacity))
    totals = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    salts = max(8, -(-max(totals.values(), default=0) // RANKED))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    below = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"))
    sweeps = best_fit_sweeps(totals, capacity)
    sweeps = spark.createDataFrame(sweeps, "length long, first_rank long, last_rank long, each long, seq long, at long")
    in_salt = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(in_salt)).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("r") + F.col("before") - 1).alias("p")
    # The sweeps' table is bounded by the capacity alone (see above), so it may be broadcast.
    s = F.broadcast(sweeps).alias("s")
    placed = ranked.join(s, F.expr("p.length = s.length and p.rank between s.first_rank and s.last_rank"))
    nth = F.expr("p.rank - s.first_rank")
    return placed.select(
        "p.doc_id",
        "p.piece",
        "p.start",
        "p.length",
        "p.ids_crc32",
        (F.col("seq") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("p.length")).cast("long").alias("offset"),
    )


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
