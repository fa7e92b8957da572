"""Embedding near-duplicates by a PCA-ordered tiled comparison.

Vectors are scaled to unit length and turned onto the principal axes of the whole table, so that
leading coordinates carry most of every product (of the AXES most frequent lengths, each its own
axes; others stay as they are, which costs time only). Inside a label and a length, vectors are range-sorted along the
first axis into tiles of bounded size; tiles further apart on that axis than two near vectors can
be are never paired. A pair of tiles is compared in one task: leading coordinates are multiplied
first, what the rest can still add is bounded by the norms of the suffixes, and rows and columns
that can no longer reach the threshold drop out before the next block of coordinates.

Equal vectors are one class compared once, so thousands of copies cost one row each. A task returns
the number of links of each class and a spanning forest of them, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .store import release, written

TILE = 512
AXES = 8  # most lengths of vectors that are turned; bounds the matrices held at once
BLOCK = 16  # coordinates multiplied before bounds are looked at again
SLACK = 1e-9  # rounding of turned unit vectors; closer to the threshold the given components decide


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.float64).reshape(-1, size) if len(column) else np.zeros((0, size))


def _by_size(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Each length of the packed vectors of a column, with the places of those that have it."""
    sizes = np.array([len(x.as_buffer()) // 8 for x in column], np.int64)
    for size in np.unique(sizes).tolist():
        yield size, pa.array(np.flatnonzero(sizes == size))


def _moments(sizes: list[int]):
    """Partial sums of x xT of unit vectors: (size, place in the matrix, number) of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, at in _by_size(batch.column(0)):
                if size in sizes:
                    x = _matrix(batch.column(0).take(at), size)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    total[size] = total.get(size, 0) + x.T @ x
        for size, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, size, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], names=["size", "at", "m"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, raw doubles) of usable vectors; -0.0 is stored as 0.0."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(2)
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        good = ~np.logical_or.reduceat(~np.isfinite(x), edge[:-1]) & np.logical_or.reduceat(x != 0, edge[:-1])
        at = np.flatnonzero(good)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([x[a:b].tobytes() for a, b in zip(edge[at], edge[at + 1])], pa.binary())],
            names=["id", "label", "v"],
        )


def _rotated(axes: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at in _by_size(batch.column(3)):
                x = _matrix(batch.column(3).take(at), size)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                y = unit @ axes[size] if size in axes else unit
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in range(3)), pa.array(np.full(len(y), size, np.int32)), pa.array(y[:, 0]), pa.array([a.tobytes() for a in y], pa.binary())],
                    names=["id", "label", "copies", "size", "lead", "y"],
                )

    return run


def _compare(left: np.ndarray, right: np.ndarray, threshold: float, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs whose product is at least threshold - slack, and whether it is also over threshold + slack.

    Pairs are given up once the suffix norms bound them below that.
    """
    size = left.shape[1]
    rest = [np.sqrt(np.maximum(np.cumsum((m * m)[:, ::-1], 1)[:, ::-1], 0)) for m in (left, right)]
    i, j = np.arange(len(left)), np.arange(len(right))
    part = np.zeros((len(i), len(j)))
    for at in range(0, size, BLOCK):
        part += left[i, at : at + BLOCK] @ right[j, at : at + BLOCK].T
        to = at + BLOCK
        if to >= size:
            break
        alive = part + rest[0][i, to][:, None] * rest[1][j, to][None, :] >= threshold - slack
        rows, columns = alive.any(1), alive.any(0)
        i, j, part = i[rows], j[columns], part[np.ix_(rows, columns)]
        if not len(i) or not len(j):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    a, b = np.nonzero(part >= threshold - slack)
    return i[a], j[b], part[a, b] > threshold + slack


def _tile_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            _, size, p, q = key
            left = [r for r in rows if r[0] == p]
            right = [r for r in rows if r[0] == q]
            same = p == q
            x, y = (np.frombuffer(b"".join(r[3] for r in side)).reshape(-1, size) for side in (left, right))
            a, b, sure = _compare(x, y, threshold)
            if same:
                a, b, sure = a[a < b], b[a < b], sure[a < b]
            lid, rid = np.array([r[1] for r in left], np.int64), np.array([r[1] for r in right], np.int64)
            lc, rc = np.array([r[2] for r in left], np.int64), np.array([r[2] for r in right], np.int64)
            if not len(a):
                return
            close = [(int(lid[i]), None, int(rid[j])) for i, j in zip(a[~sure], b[~sure])]
            a, b = a[sure], b[sure]
            degree: dict[int, int] = {}
            for ids, other, k, o in ((lid, rc, a, b), (rid, lc, b, a)):
                sums = np.bincount(k, other[o].astype(np.float64), len(ids)).astype(np.int64)
                for n in np.flatnonzero(sums):
                    degree[int(ids[n])] = degree.get(int(ids[n]), 0) + int(sums[n])
            links = _forest(lid[a], rid[b])
            ids = list(degree)
            out = [(i, degree[i], None) for i in ids] + [(u, 0, v) for u, v in links] + close
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())],
                names=["id", "n", "to"],
            )

        for batch in batches:
            for label, size, p, q, tile, id_, copies, y in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if (label, size, p, q) != key:
                    yield from done()
                    key, rows = (label, size, p, q), []
                rows.append((tile, id_, copies, y))
        yield from done()

    return run


def _decided(threshold: float):
    """Pairs whose vectors, as they are given, have a cosine of at least threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(4), batch.column(5)):
                x, y = np.frombuffer(a.as_buffer()), np.frombuffer(b.as_buffer())
                good.append(bool(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(good, pa.bool_()))

    return run


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links u-v."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for a, b in zip(u.tolist(), v.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def embedding_near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Link vectors of equal label and length whose cosine, in double precision, is at least threshold (over 0).

    Returns (id, n_links, component_id, kept), one row for each input row: n_links counts the other
    rows linked directly, component_id is the smallest id reachable, kept where it is the row's own.
    Vectors that are null, empty, zero, or that hold null or non-finite components link with
    nothing, nor do rows with a null label. Rows with a null id are left out. Rows that repeat an id are one node; copies of it count as links of each other.
    An empty table gives no rows. Other columns are ignored.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null")
    usable = source.filter("label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    packed = usable.mapInArrow(_packed, usable.drop("v").schema.add("v", "binary"))
    packed = packed.withColumn("h", F.sha2("v", 256))
    classes = written(packed.groupBy("label", "h").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")))
    sizes = classes.groupBy(F.expr("cast(octet_length(v) / 8 as int)").alias("size")).count().orderBy(F.desc("count"), "size").limit(AXES).collect()
    moments = {r.size: np.zeros((r.size, r.size)) for r in sizes}
    sums = classes.select("v").mapInArrow(_moments(list(moments)), "size int, at int, m double").groupBy("size", "at").agg(F.sum("m").alias("m"))
    for size, part in sums.toPandas().groupby("size"):  # AXES matrices at most
        moments[size].ravel()[part["at"]] = part["m"]
    axes = {size: np.linalg.eigh(m)[1][:, ::-1] for size, m in moments.items()}
    turned = classes.select("id", "label", "copies", "v").mapInArrow(_rotated(axes), "id long, label " + classes.schema["label"].dataType.simpleString() + ", copies long, size int, lead double, y binary")
    turned = written(turned)
    # Range-sorted tiles: bins along the first axis, small neighbours together, large ones split by hash.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9)
    bins = turned.withColumn("bin", F.floor((F.col("lead") + 1) / F.lit(reach / 16)).cast("long"))
    run = Window.partitionBy("label", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    tiles = bins.groupBy("label", "size", "bin").agg(F.count("*").alias("n")).select(
        "label", "size", "bin", F.ceil(F.col("n") / TILE).cast("int").alias("parts"), F.floor(F.coalesce(F.sum("n").over(run), F.lit(0)) / TILE).alias("tile")
    )
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    t = F.when(F.col("parts") > 1, F.xxhash64(F.lit("split"), "bin", part)).otherwise(F.xxhash64(F.lit("whole"), "tile"))
    tiled = bins.join(tiles, ["label", "size", "bin"]).withColumn("t", t)
    tiled = written(tiled.select("label", "size", "t", "id", "copies", "lead", "y"))
    spans = tiled.groupBy("label", "size", "t").agg(F.min("lead").alias("lo"), F.max("lead").alias("hi"))
    # Tiles are paired by bins of at least one reach along the first axis: near tiles share a bin or lie in adjacent ones.
    wide = max(reach, 1 / 32)

    def bin_of(c: str):
        return F.floor(F.col(c) / wide).cast("long")

    a = spans.select("label", "size", F.col("t").alias("p"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.explode(F.sequence(bin_of("lo") - 1, bin_of("hi") + 1)).alias("bin"))
    b = spans.select("label", "size", F.col("t").alias("q"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.sequence(bin_of("lo"), bin_of("hi"))).alias("bin"))
    pairs = a.join(b, ["label", "size", "bin"]).filter((F.col("p") <= F.col("q")) & (F.col("lo2") - F.col("hi1") <= reach) & (F.col("lo1") - F.col("hi2") <= reach))
    pairs = pairs.select("label", "size", "p", "q").distinct()
    sides = pairs.select("label", "size", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("t"))
    dealt = sides.join(tiled, ["label", "size", "t"]).select("label", "size", "p", "q", "t", "id", "copies", "y")
    dealt = dealt.repartition("label", "size", "p", "q").sortWithinPartitions("label", "size", "p", "q")
    found = written(dealt.mapInArrow(_tile_pairs(threshold), "id long, n long, to long"))
    # Pairs within SLACK of the threshold (n is null) are decided by the cosine of the given components.
    one = classes.select("id", F.col("copies").alias("ca"), F.col("v").alias("a"))
    two = classes.select(F.col("id").alias("to"), F.col("copies").alias("cb"), F.col("v").alias("b"))
    close = found.filter("n is null").select("id", "to").join(one, "id").join(two, "to").select("id", "to", "ca", "cb", "a", "b")
    close = written(close.mapInArrow(_decided(threshold), "id long, to long, ca long, cb long"))
    release(turned)
    release(tiled)
    more = close.select("id", F.col("cb").alias("n")).union(close.select("to", "ca"))
    found = found.filter("n is not null").union(more.select("id", "n", F.lit(None).cast("long"))).union(close.select("id", F.lit(0).cast("long"), "to"))
    degree = found.filter("to is null").groupBy("id").agg(F.sum("n").alias("n"))
    rows = packed.select(F.col("id").alias("row_id"), "label", "h").join(classes.select("label", "h", "id", "copies"), ["label", "h"])
    linked = rows.join(degree, "id", "left").select(F.col("row_id").alias("id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("id").alias("rep"))
    linked = written(linked)
    edges = found.filter("to is not null").select(F.col("id").alias("src"), F.col("to").alias("dst"))
    groups = connected_components(edges.union(linked.filter("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst"))))
    best = linked.groupBy("id").agg(F.max("links").alias("links"))
    out = source.select("id").join(best, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return embedding_near_duplicates(vectors, 0.93).withColumnRenamed("id", "vec_id")


OP8_SQL = r"""
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings),
g as (
  select vec_id, label, e from v
  where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n from l group by a)
select v.vec_id, coalesce(n.n, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c on c.a = v.vec_id left join n on n.a = v.vec_id
"""
