"""Document fingerprints from closed syncmers.

A k-mer of a text's bytes is a closed syncmer when the smallest of its inner s-mers (by hash) is its
first or its last. The choice depends on the k-mer alone, so an edit elsewhere never changes it:
syncmers are context-free anchors. A fingerprint holds the anchors with the smallest hashes, each
with its byte position. Two fingerprints are compared on the smallest anchors of their union, and
shared anchors count only where other shared anchors have moved as far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import shuffle_width, small_batches
from .text import Slice, _power_tables, mix, range_hashes, slices

K, S = 12, 5
ANCHORS = 64
DRIFT = 256  # bytes by which the shifts of anchors that agree may differ
AGREE = 3  # anchors, itself among them, with which a shared anchor's shift has to agree

Anchors = tuple[np.ndarray, np.ndarray]


def _smer_hashes(data: np.ndarray) -> np.ndarray:
    p, q = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    return mix((sums[S:] - sums[:-S]) * q[: len(data) - S + 1])


def syncmers(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, byte position in the row, hash) of all closed syncmers of a slice."""
    none = np.zeros(0, np.int64)
    if len(part.data) < K:
        return none, none, np.zeros(0, np.uint64)
    h = _smer_hashes(part.data)
    span = K - S + 1
    low, reach = h, 1
    while reach < span:
        step = min(reach, span - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    at = np.flatnonzero((h[: len(low)] == low) | (h[span - 1 :] == low))
    row = np.searchsorted(part.offsets, at, "right") - 1
    inside = at + K <= part.offsets[row + 1]
    at, row = at[inside], row[inside]
    return row, at - part.offsets[row], range_hashes(part.data, at, at + K)


def _smallest(rows: int, row: np.ndarray, pos: np.ndarray, h: np.ndarray, most: int) -> list[Anchors]:
    """For each row its `most` smallest distinct hashes with their first positions."""
    counts = np.bincount(row, minlength=rows)
    # Rows with many anchors are first cut to hashes that are small enough for about 4 * most of them.
    limit = np.where(counts > 8 * most, 4.0 * most / np.maximum(counts, 1), 1.0)
    near = h.astype(np.float64) <= limit[row] * 2.0**64
    out: list[Anchors] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * rows

    def take(pick: np.ndarray) -> np.ndarray:
        r, p, x = row[pick], pos[pick], h[pick]
        order = np.lexsort((p, x, r))
        r, p, x = r[order], p[order], x[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
        r, p, x = r[new], p[new], x[new]
        edge = np.searchsorted(r, np.arange(rows + 1))
        for i in np.unique(r):
            a, b = edge[i], min(edge[i + 1], edge[i] + most)
            out[i] = ((x[a:b] >> np.uint64(32)).astype(np.int64), p[a:b])
        return np.diff(edge)

    found = take(np.flatnonzero(near))
    # Texts that repeat themselves have few distinct anchors: these rows are taken again, uncut.
    again = (found < most) & (limit < 1)
    if again.any():
        take(np.flatnonzero(again[row]))
    return out


def fingerprints(part: Slice, most: int = ANCHORS) -> list[Anchors]:
    """Fingerprint of each text: (hashes ascending, positions). A text without a syncmer has itself as one anchor."""
    row, pos, h = syncmers(part)
    out = _smallest(len(part), row, pos, h, most)
    bare = np.flatnonzero((np.bincount(row, minlength=len(part)) == 0) & (np.diff(part.offsets) > 0))
    if len(bare):
        whole = range_hashes(part.data, part.offsets[bare], part.offsets[bare + 1])
        for i, x in zip(bare, whole):
            out[i] = (np.array([int(x) >> 32]), np.zeros(1, np.int64))
    return out


def as_text(anchors: Anchors) -> str:
    return " ".join(f"{h:08x}@{p}" for h, p in zip(*(x.tolist() for x in anchors)))


def likeness(a: Anchors, b: Anchors, most: int = ANCHORS) -> float:
    """Share of text in common, 0 to 1, as far as two fingerprints tell. Two empty ones are alike."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    union = np.union1d(a[0], b[0])[:most]
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=False, return_indices=True)
    inside = both <= union[-1]
    shift = (b[1][j] - a[1][i])[inside]
    if not len(shift):
        return 0.0
    # A passage put in or taken out moves what follows: every shift that several anchors share counts.
    shift = np.sort(shift)
    near = np.searchsorted(shift, shift + DRIFT, "right") - np.searchsorted(shift, shift - DRIFT, "left")
    agreed = int((near >= min(AGREE, len(shift))).sum())
    jaccard = min(1.0, agreed / len(union))
    return 2 * jaccard / (1 + jaccard)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, next): next is the text of the document with the next smaller id; after the last comes the first.

    Documents are range-partitioned by id, and the first document of each range is copied to the
    range before it, so every text is shuffled once and no order is global to one task. Of rows that
    repeat an id the larger text comes first. A single row is its own next.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("id is not null")
    n = shuffle_width(spark)
    cuts = source.select("id").approxQuantile("id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    splits = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    ranges = Bucketizer(splits=splits, inputCol="x", outputCol="range")
    source = ranges.transform(source.withColumn("x", F.col("id").cast("double"))).select("id", "text", F.col("range").cast("int").alias("range"))
    heads = sorted(source.groupBy("range").agg(F.max("id")).collect())  # one row for each range
    to = [(h, heads[(i + 1) % len(heads)][0]) for i, (_, h) in enumerate(heads)]
    copies = source.join(F.broadcast(spark.createDataFrame(to, "id long, to int")), "id").select("id", "text", F.col("to").alias("range"), F.lit(True).alias("copy"))
    dealt = source.withColumn("copy", F.lit(False)).union(copies)
    order = Window.partitionBy("range").orderBy("copy", F.desc("id"), F.desc("text"))
    return dealt.withColumn("next", F.lead("text").over(order)).filter("not copy").select("id", "text", "next")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edited text, and hold them against one another.

    The edited text has the last third of its characters (rounded down) replaced by the first as
    many, or all, of the next document's by descending id. Returns (id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next), one row for each input row. Null texts
    are empty; an empty text has an empty fingerprint. Rows with a null id are left out. Other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    third = F.floor(F.col("n_chars") / 3).cast("int")
    pairs = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text"))
    pairs = pairs.select(
        "id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "text",
        F.concat(F.substring("text", F.lit(1), F.col("n_chars") - third), F.substring("next", F.lit(1), third)).alias("edited"),
        "next",
    )
    pairs = pairs.select("id", "n_chars", "text", "edited", "next", F.sha2("edited", 256).alias("edited_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, edited, following = ([f for part in slices(batch.column(c)) for f in fingerprints(part)] for c in (2, 3, 4))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(5),
                    pa.array([as_text(f) for f in own], pa.string()),
                    pa.array([as_text(f) for f in edited], pa.string()),
                    pa.array([likeness(a, b) for a, b in zip(own, edited)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(own, following)], pa.float64()),
                ],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return pairs.mapInArrow(
        run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
