"""Substring dedup over a de Bruijn graph of words, compacted through joins.

The edges of the graph are the w-word windows of all texts (w = 20). As in minimiser-partitioned
graph builders, each edge belongs to the smallest k-mer inside it, and the run of consecutive
edges that share that k-mer occurrence is one path: its source coordinate, its length in edges and
a hash of its words. A k-mer all of whose occurrences lie on one and the same path does not branch,
and its edges stay compacted: every occurrence but the first repeats as a whole. Where a k-mer has
several paths, the node branches: only the first occurrence of each path is opened into single
edges, which are joined by their own hash. The coordinates decide which occurrence is the earliest.

Each batch settles the repeats it holds itself. Paths, the number of paths of a node, and edges are
aggregated before they are shuffled and joined back; a path, node or edge with many rows is joined
by a broadcast of its one aggregate, so none is gathered in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import skew
from .skew import join_groups
from .store import release, small_batches, written
from .text import Slice, mix, range_hashes, slices, window_starts, word_ranges

KMER = 6
_SALT = np.uint64(0x5851F42D4C957F2D)


def _paths(token: np.ndarray, bounds: np.ndarray, window: int, k: int):
    """Paths of a slice: (row, first edge, edges, k-mer hash, content hash), first edge counted in the row."""
    first, wide = window_starts(bounds, window)
    if not len(first):
        return None
    span = window - k + 1
    grams, _ = window_starts(np.array([0, len(token)]), k)
    order = mix(range_hashes(token, grams, grams + k) ^ _SALT)
    # Leftmost smallest k-mer of each window, by doubling the reach of a running minimum.
    best = np.arange(len(order))
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        later = best[step:]
        now = best[: len(later)]
        best = np.where(order[later] < order[now], later, now)
        reach += step
    pick = best[first]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(wide))
    new = np.ones(len(first), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    edges = np.diff(np.append(at, len(first)))
    lo = first[at]
    content = range_hashes(token, lo, lo + edges + window - 1)
    # The place of the k-mer in the path tells apart equal words split differently.
    content = mix(content + (pick[at] - lo).astype(np.uint64))
    return row[at], lo - bounds[row[at]], edges, order[pick[at]], content


def _path_rows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = []
            for part in slices(batch.column(1)):
                starts, ends, bounds = word_ranges(part)
                one = _paths(range_hashes(part.data, starts, ends), bounds, window, k) if len(starts) else None
                if one is not None:
                    row, lo, edges, kmer, content = one
                    found.append((ids[part.rows][row], (lo << 8) | edges, kmer, content))
            if not found:
                continue
            id_, place, kmer, path = (np.concatenate(x) for x in zip(*found))
            # Of a path that the batch repeats only its first place needs the rest of the corpus.
            order = np.lexsort((place, id_, path, kmer))
            first = np.ones(len(order), bool)
            first[1:] = (kmer[order][1:] != kmer[order][:-1]) | (path[order][1:] != path[order][:-1])
            again = np.ones(len(order), bool)
            again[order[first]] = False
            # Equal places (rows that repeat an id) are not earlier than one another.
            lead = order[first][np.cumsum(first) - 1]
            same = (id_[order] == id_[lead]) & (place[order] == place[lead]) & ~first
            keep = np.ones(len(order), bool)
            keep[order[same]] = False
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kmer[keep].view(np.int64), mask=again[keep]),
                    pa.array(path[keep].view(np.int64), mask=again[keep]),
                    pa.array(id_[keep]),
                    pa.array(place[keep]),
                ],
                names=["kmer", "path", "id", "place"],
            )

    return run


def _edge_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            places = batch.column(2)
            for part in slices(batch.column(1)):
                starts, ends, bounds = word_ranges(part)
                if not len(starts):
                    continue
                token = range_hashes(part.data, starts, ends)
                mine = places.slice(part.rows.start, len(part))
                flat = mine.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(part)), mine.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                lo, edges = flat >> 8, flat & 255
                row = np.repeat(owner, edges)
                at = np.repeat(lo, edges) + np.arange(edges.sum()) - np.repeat(np.cumsum(edges) - edges, edges)
                fits = at + window <= np.diff(bounds)[row]  # only rows that repeat an id can fail this
                row, at = row[fits], at[fits]
                first = at + bounds[row]
                h = range_hashes(token, first, first + window)
                order = np.lexsort((at, h, row))
                keep = np.ones(len(order), bool)
                keep[1:] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])
                keep = order[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[keep].view(np.int64)), pa.array(ids[part.rows][row[keep]]), pa.array((at[keep] << 8) | 1)],
                    names=["edge", "id", "place"],
                )

    return run


def _removed(token: np.ndarray, bounds: np.ndarray, window: int, row: np.ndarray, lo: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Mask of the words covered by the given edges and by edges that an earlier place of the same row has."""
    cover = np.zeros(len(token) + 1, np.int64)
    fits = lo + edges + window - 1 <= np.diff(bounds)[row]
    a = (lo + bounds[row])[fits]
    np.add.at(cover, a, 1)
    np.add.at(cover, a + edges[fits] + window - 1, -1)
    first, wide = window_starts(bounds, window)
    if len(first):
        h = range_hashes(token, first, first + window)
        r = np.repeat(np.arange(len(bounds) - 1), np.diff(wide))
        order = np.lexsort((first, h, r))
        again = np.zeros(len(order), bool)
        again[1:] = (r[order][1:] == r[order][:-1]) & (h[order][1:] == h[order][:-1])
        b = first[order[again]]
        np.add.at(cover, b, 1)
        np.add.at(cover, b + window, -1)
    return np.cumsum(cover[:-1]) > 0


def _cleaned(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2)
            for part in slices(batch.column(1)):
                starts, ends, bounds = word_ranges(part)
                mine = places.slice(part.rows.start, len(part))
                flat = mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(part)), mine.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                gone = np.zeros(0, bool)
                if len(starts):
                    gone = _removed(range_hashes(part.data, starts, ends), bounds, window, owner, flat >> 8, flat & 255)
                texts = _kept_texts(part, starts, ends, bounds, ~gone)
                total = np.concatenate([[0], np.cumsum(gone)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.rows.start, len(part)),
                        pa.array(np.diff(bounds)),
                        pa.array(total[bounds[1:]] - total[bounds[:-1]]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                        pa.array([x.decode() for x in texts]),
                    ],
                    names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def _kept_texts(part: Slice, starts, ends, bounds, keep) -> list[bytes]:
    """The kept words of each row joined by one space."""
    if not len(starts):
        return [b""] * len(part)
    at = np.flatnonzero(keep)
    size = ends[at] - starts[at] + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(to[-1]), 0x20, np.uint8)
    letters = size - 1
    inside = np.arange(letters.sum()) - np.repeat(np.cumsum(letters) - letters, letters)
    out[np.repeat(to[:-1], letters) + inside] = part.data[np.repeat(starts[at], letters) + inside]
    edge = to[np.searchsorted(at, bounds)]
    raw = out.tobytes()
    return [raw[edge[i] : max(edge[i], edge[i + 1] - 1)] for i in range(len(part))]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Remove every word covered by a window of words whose sequence also starts earlier.

    Earlier is a smaller id, or the same id and an earlier start; windows are judged on the input.
    Returns (id, n_words, n_removed, kept_sha256, kept_text), kept words joined by one space. Null
    texts have no words. Texts shorter than a window are returned whole. Rows with a null id are
    left out. Rows that repeat an id are judged as one document whose windows start at the same
    places: equal windows at equal places remove neither. Other columns are ignored.
    """
    if not KMER < window <= 200:
        raise ValueError("window must be over 6 and at most 200 words")
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    texts = source.repartition("id")
    paths = written(source.mapInArrow(_path_rows(window, KMER), "kmer long, path long, id long, place long"))
    # No key has this many rows in more than a bounded number of cases, whatever the size of the corpus.
    large = max(skew.LEAST, source.count() // 100)
    known = paths.filter("kmer is not null")
    at = F.struct("id", "place")
    # A path's hash fixes its words and its node's place in them, and so its node.
    by_path = known.groupBy("path").agg(F.min(at).alias("first"), F.min("kmer").alias("kmer"), F.count("*").alias("n"))
    # Compacted: all but the first occurrence of a path repeat as a whole.
    again = join_groups(known.select("path", "id", "place"), by_path.filter("n > 1").select("path", "first", "n"), ["path"], "n", 0, large).filter(F.col("first") < at)
    repeats = written(paths.filter("kmer is null").select("id", "place").union(again.select("id", "place")))
    # Branching: nodes on several paths, the first occurrence of each path opened into edges.
    nodes = by_path.groupBy("kmer").agg(F.count("*").alias("paths")).filter("paths > 1")
    opened = join_groups(by_path.select("kmer", "first.id", "first.place"), nodes, ["kmer"], "paths", 0, large)
    opened = written(opened.groupBy("id").agg(F.collect_list("place").alias("places")))
    edges = texts.join(opened, "id").select("id", "text", "places").mapInArrow(_edge_rows(window), "edge long, id long, place long")
    edges = written(edges)
    release(paths)
    release(opened)
    lowest = edges.groupBy("edge").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1")
    single = join_groups(edges, lowest, ["edge"], "n", 0, large).filter(F.col("first") < at).select("id", "place")
    places = repeats.union(single).groupBy("id").agg(F.collect_list("place").alias("places"))
    whole = texts.join(places, "id", "left").select("id", "text", "places")
    return whole.mapInArrow(_cleaned(window), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = substring_dedup(docs)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as (select doc_id, unnest(range(1, len(ws) - 18)) as p, ws from w where len(ws) >= 20),
h as (select doc_id, p, md5(array_to_string(ws[p:p+19], ' ')) as k from g),
f as (select k, min((doc_id, p)) as first from h group by k having count(*) > 1),
x as (select h.doc_id, h.p from h join f on h.k = f.k where (h.doc_id, h.p) > f.first),
c as (select distinct doc_id, unnest(range(p, p + 20)) as i from x),
m as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w where len(ws) > 0),
k as (select m.doc_id, count(*) as n, count(c.i) as gone, string_agg(case when c.i is null then m.ws[m.i] end, ' ' order by m.i) as kept
      from m left join c on c.doc_id = m.doc_id and c.i = m.i group by m.doc_id)
select w.doc_id, coalesce(k.n, 0) as n_words, coalesce(k.gone, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k on k.doc_id = w.doc_id
"""
