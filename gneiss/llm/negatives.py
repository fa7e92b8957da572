"""Hard negatives by distributed radix selection.

Anchors are a stated query set, met by all rows in blocks of BLOCK: a block with its windows is broadcast, and every
task streams its rows past it, so rows are never shuffled. A window is what an anchor looks for: the rows of its own
label, or rows of other labels with a score in a range. A round sends histograms only, one count for each window and
digit of the integer score, summed in the task first. Summed over tasks they tell which digit holds the k-th row, and
the next round counts the next digit of that one alone; after the score's last digit come the digits of the id, so that
ties are counted apart too. Once no more than GATHER rows lie up to that digit, those rows, and no others, are gathered and ranked.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import release, shared_dir, written

BLOCK = 8192  # anchors broadcast at once
CELLS = 1 << 21  # scores held at once by a task
DIGIT = 6  # bits
GATHER = 64  # rows of a window that are gathered instead of counted further
EXACT = 1 << 53  # squared length up to which products in doubles are exact
FOUND = "anchor long, w int, id long, score long"


def _quantised(scale: int):
    """(id, label, q, norm): q the packed int32 of floor(scale * x), norm its squared length; rows with a non-finite component are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            edge = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            sums = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            at = np.flatnonzero(sums[edge[1:]] == sums[edge[:-1]])
            q = np.floor(scale * np.where(np.isfinite(x), x, 0))
            sums = np.concatenate([[0], np.cumsum(q * q)])
            norm = (sums[edge[1:]] - sums[edge[:-1]])[at]
            if norm.size and not norm.max() < EXACT / 2:
                raise ValueError(f"vectors longer than {int((EXACT / 2) ** 0.5) // scale} have no exact integer products here")
            norm = np.array([int(q[a:b] @ q[a:b]) for a, b in zip(edge[at], edge[at + 1])], np.int64)
            packed = pa.array([q[a:b].astype(np.int32).tobytes() for a, b in zip(edge[at], edge[at + 1])], pa.binary())
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), packed, pa.array(norm)], names=["id", "label", "q", "norm"])

    return run


@dataclass
class Windows:
    """Open windows of one block, an array entry for each.

    Rows are counted by how far their score lies below `hi`; where `tied` (then lo = hi), by their id from id_lo on.
    Already counted as `ahead`: rows with a score over hi up to `top`, and tied ones with an id below id_lo. Ids count in steps of
    four, so that any 64-bit id has its place.
    """

    anchor: np.ndarray
    w: np.ndarray
    other: np.ndarray
    top: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    shift: np.ndarray
    tied: np.ndarray
    id_lo: np.ndarray
    id_hi: np.ndarray
    ahead: np.ndarray
    done: np.ndarray

    @classmethod
    def of(cls, anchor, w, other: bool, lo, hi) -> Windows:
        n, zero = len(anchor), np.zeros(len(anchor), np.int64)
        bits = np.array([int(b - a).bit_length() for a, b in zip(lo, hi)], np.int64)
        return cls(anchor, w, np.full(n, other), hi.copy(), lo, hi, np.maximum(bits - DIGIT, 0), np.zeros(n, bool), zero.copy(), zero.copy(), zero.copy(), np.zeros(n, bool))

    def where(self, mask: np.ndarray) -> Windows:
        return Windows(*(getattr(self, f)[mask] for f in self.__dataclass_fields__))

    def narrow(self, i: int, total: int, digit: int | None, upto: int, n: int, ids: tuple[int, int]) -> None:
        """After a round: `total` rows were counted; the k-th lies in `digit`, up to whose end there are upto and inside it n rows."""
        if self.ahead[i] + total <= GATHER or digit is None:  # all that is left, be it fewer than k, may be gathered
            self.done[i] = True
            return
        width = 1 << int(self.shift[i])
        if self.tied[i]:
            self.id_lo[i] += digit * width
            self.id_hi[i] = min(self.id_hi[i], self.id_lo[i] + width - 1)
        else:
            self.hi[i] -= digit * width
            self.lo[i] = max(self.lo[i], self.hi[i] - width + 1)
        self.done[i] = self.ahead[i] + upto <= GATHER or (width == 1 and self.tied[i])
        self.ahead[i] += upto - n
        if self.done[i]:
            return
        if width > 1:
            self.shift[i] = max(int(self.shift[i]) - DIGIT, 0)
        else:
            self.tied[i], self.id_lo[i], self.id_hi[i] = True, *ids
            self.shift[i] = max((ids[1] - ids[0]).bit_length() - DIGIT, 0)


@dataclass
class Block:
    """Anchors of one length of vector and, by rank, the windows of those that have so many."""

    id: np.ndarray
    label: np.ndarray
    q: np.ndarray
    windows: list[tuple[np.ndarray, Windows]]

    def tiles(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        """(ids, scores, equal labels, own row): rows x anchors."""
        step = max(1, CELLS // max(1, len(self.id)))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            yield ids[part], (q[part] @ self.q.T).astype(np.int64), labels[part, None] == self.label, ids[part, None] == self.id


def _blocks(anchors: pd.DataFrame, windows: Windows) -> dict[int, Block]:
    """The broadcast form of a block: anchors by length of vector, each with its windows."""
    out = {}
    place = _places(windows.anchor)
    for size, part in anchors.groupby(anchors["q"].map(len) // 4):
        part = part[part["id"].isin(place.keys())]
        if not len(part):
            continue
        mine = [place[int(i)] for i in part["id"]]
        ranks = []
        for j in range(max(map(len, mine))):
            at = np.array([i for i, m in enumerate(mine) if len(m) > j], np.int64)
            ranks.append((at, windows.where(np.array([mine[i][j] for i in at], np.int64))))
        q = np.frombuffer(b"".join(part["q"]), np.int32).reshape(len(part), int(size)).astype(np.float64)
        out[int(size)] = Block(part["id"].to_numpy(np.int64), part["label"].to_numpy(np.int64), q, ranks)
    return out


def _places(keys: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    values, first = np.unique(keys[order], return_index=True)
    return dict(zip(values.tolist(), np.split(order, first[1:])))


def _wanted(w: Windows, at: np.ndarray, scores: np.ndarray, same: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return scores[:, at], np.where(w.other, ~same[:, at], same[:, at] & ~own[:, at])


def _streams(batches: Iterator[pa.RecordBatch], blocks: dict[int, Block]):
    """(block, ids, labels, vectors) of each batch and length that anchors have too."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) // 4 for x in batch.column(2)], np.int64)
        for size in np.unique(sizes).tolist():
            if size in blocks:
                at = np.flatnonzero(sizes == size)
                q = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(2).take(pa.array(at))), np.int32).reshape(len(at), size)
                yield size, batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at], q.astype(np.float64)


def _histograms(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        counts = {size: [np.zeros(len(at) << DIGIT, np.int64) for at, _ in b.windows] for size, b in blocks.items()}
        for size, ids, labels, q in _streams(batches, blocks):
            for id_, scores, same, own in blocks[size].tiles(ids, labels, q):
                for (at, w), out in zip(blocks[size].windows, counts[size]):
                    s, good = _wanted(w, at, scores, same, own)
                    row, col = np.nonzero(good & (s >= w.lo) & (s <= w.hi))
                    step, tied = id_[row] >> 2, w.tied[col]
                    inside = ~tied | ((step >= w.id_lo[col]) & (step <= w.id_hi[col]))
                    key = np.where(tied, step - w.id_lo[col], w.hi[col] - s[row, col])[inside]
                    col = col[inside]
                    out += np.bincount((col << DIGIT) + (key >> w.shift[col]), minlength=len(out))
        for size, b in blocks.items():
            for (at, w), out in zip(b.windows, counts[size]):
                cell = np.flatnonzero(out)
                if len(cell):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(b.id[at[cell >> DIGIT]]), pa.array(w.w[cell >> DIGIT].astype(np.int32)), pa.array((cell & ((1 << DIGIT) - 1)).astype(np.int32)), pa.array(out[cell])],
                        names=["anchor", "w", "digit", "n"],
                    )

    return run


def _gathered(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        for size, ids, labels, q in _streams(batches, blocks):
            b = blocks[size]
            for id_, scores, same, own in b.tiles(ids, labels, q):
                for at, w in b.windows:
                    s, good = _wanted(w, at, scores, same, own)
                    good &= (s >= w.lo) & (s <= w.top) & (~w.tied | (s > w.lo) | (id_[:, None] >> 2 <= w.id_hi))
                    row, col = np.nonzero(good)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(b.id[at[col]]), pa.array(w.w[col].astype(np.int32)), pa.array(id_[row]), pa.array(s[row, col])], names=["anchor", "w", "id", "score"])

    return run


def _first(rows: DataFrame, anchors: pd.DataFrame, windows: Windows, k: int, ids: tuple[int, int]) -> DataFrame:
    """(anchor, w, id, score, rank) of the first k rows of each window, by score descending, then id. ids: the smallest and largest id in steps of four."""
    spark = rows.sparkSession
    while not windows.done.all():
        shared = spark.sparkContext.broadcast(_blocks(anchors, windows.where(~windows.done)))
        counted = rows.mapInArrow(_histograms(shared), "anchor long, w int, digit int, n long").groupBy("anchor", "w", "digit").agg(F.sum("n").alias("n"))
        group = Window.partitionBy("anchor", "w")
        up = counted.withColumns({"upto": F.sum("n").over(group.orderBy("digit")), "total": F.sum("n").over(group)})
        ahead = spark.createDataFrame(pd.DataFrame({"anchor": windows.anchor, "w": windows.w, "ahead": windows.ahead})[~windows.done], "anchor long, w int, ahead long")
        # Of each window the digit that reaches k rows, or the last one: a row for each of a block's windows.
        here = up.join(F.broadcast(ahead), ["anchor", "w"]).withColumn("reached", F.col("ahead") + F.col("upto") >= k)
        at = here.groupBy("anchor", "w").agg(F.min(F.when(F.col("reached"), F.struct("digit", "upto", "n"))).alias("at"), F.max("total").alias("total")).select("anchor", "w", "total", "at.*").toPandas()
        shared.destroy()
        found = {(a, w): (int(total), None if pd.isna(digit) else int(digit), 0 if pd.isna(digit) else int(upto), 0 if pd.isna(digit) else int(n)) for a, w, total, digit, upto, n in at.itertuples(index=False)}
        for i in np.flatnonzero(~windows.done):
            windows.narrow(i, *found.get((int(windows.anchor[i]), int(windows.w[i])), (0, None, 0, 0)), ids)
    shared = spark.sparkContext.broadcast(_blocks(anchors, windows))
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), F.asc("id"))
    return rows.mapInArrow(_gathered(shared), FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors_where: str = "id % 100 = 0",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors that `anchors_where` names.

    Components become floor(scale * x); a score is the integer inner product with the anchor. An anchor's
    positives are its first `positives` other rows of the same label, by score descending, then id. For each,
    the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score follow,
    ranked alike. positives and negatives are GATHER at most.

    Rows with a null id, label or vector, or a null or non-finite component take no part; only vectors of equal length are compared
    (empty ones score 0). Zero vectors score 0. Labels are integers. Rows that repeat an id are rows of their
    own, but never an anchor's own positives; as an anchor the first of them by label and vector counts. An anchor without positives, or whose windows hold
    nothing, has no rows; an empty table gives none. Vectors whose products pass 2^52 are refused. Other columns are ignored.
    """
    if not 0 < positives <= GATHER or not 0 < negatives <= GATHER:
        raise ValueError(f"positives and negatives are from 1 to {GATHER}")
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    source = source.filter("id is not null and label is not null and v is not null and not exists(v, x -> x is null)")
    rows = written(source.mapInArrow(_quantised(scale), "id long, label long, q binary, norm long"))
    anchors = rows.filter(anchors_where).groupBy("id").agg(F.min(F.struct("label", "q")).alias("a")).select("id", "a.*")
    least, most, reach = rows.agg(F.min("id"), F.max("id"), F.max("norm")).first()
    blocks = -(-anchors.count() // BLOCK)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    out_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], out_schema).write.parquet(path)
    for i in range(blocks):  # a block's anchors, windows and results are bounded by BLOCK
        some = anchors.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toPandas()
        ids = (int(least) >> 2, int(most) >> 2)
        n = len(some)
        full = Windows.of(some["id"].to_numpy(np.int64), np.zeros(n, np.int64), False, np.full(n, -reach, np.int64), np.full(n, reach, np.int64))
        best = _first(rows, some, full, positives, ids).toPandas()
        score = best["score"].to_numpy(np.int64)
        lo, hi = -((-low * score) // 100), (high * score) // 100
        best["w"] = best["rank"]
        ranges = Windows.of(best["anchor"].to_numpy(np.int64), best["w"].to_numpy(np.int64), True, lo, hi).where(lo <= hi)
        if not len(ranges.anchor):
            continue
        found = _first(rows, some, ranges, negatives, ids)
        positive = F.broadcast(spark.createDataFrame(best[["anchor", "w", "id", "score"]], "anchor long, w int, positive_id long, positive_score long"))
        found = found.join(positive, ["anchor", "w"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        found.write.mode("append").parquet(path)
    release(rows)
    return spark.read.schema(out_schema).parquet(path)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", relabelled))


OP13_SQL = r"""
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, cast(embedding as double[]) as e from embeddings),
q as (
  select id, label, list_transform(e, lambda x: cast(floor(256 * x) as bigint)) as q from v
  where id is not null and label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.id as anchor, b.id as other, a.label = b.label as same, cast(list_inner_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) as score
  from q a join q b on a.id % 100 = 0 and a.id <> b.id and len(a.q) = len(b.q)),
p as (select anchor, other as positive, score from s where same qualify row_number() over (partition by anchor order by score desc, other) <= 5),
n as (
  select p.anchor as anchor_id, p.positive as positive_id, s.other as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor, p.positive order by s.score desc, s.other) as rank
  from p join s on s.anchor = p.anchor and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
