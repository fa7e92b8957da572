"""MinHash near-duplicate groups: fast similarity sketching, banding, exact verification.

Sketching follows the published rounds: in round i < t every shingle is hashed to one random
coordinate with a value that starts at i, in round t + j every shingle goes to coordinate j. A
coordinate keeps its smallest value, a document stops once all its coordinates are filled, and
round 2t - 1 fills the last one for certain. Cost is O(n + t log t) instead of O(n t).

Candidate pairs come from equal bands. No bucket is ever paired out: each member is held against
the smallest member of its bucket, the hub, and components are formed. Members of a bucket that are
still in different components are dealt by hub over tiles of bounded size. Each pair of tiles is
compared inside one task, unless both lie in the hub's component, and returns only links that join
components. So copies cost one row each, and a bucket loses no link between texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .skew import join_groups
from .store import release, small_batches, trimmed, written
from .text import lowered, mix, range_hashes, slices, window_starts, word_ranges

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(part, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, bounds of each row). Short rows have one shingle."""
    starts, ends, bounds = word_ranges(part)
    counts = np.diff(bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(part) + 1, np.int64)
    token = range_hashes(lowered(part.data), starts, ends)
    first, wide = window_starts(bounds, k)
    lo, hi, row = first, first + k, np.repeat(np.arange(len(counts)), np.diff(wide))
    short = np.flatnonzero((counts > 0) & (counts < k))
    lo, hi = np.concatenate([lo, bounds[short]]), np.concatenate([hi, bounds[short + 1]])
    row = np.concatenate([row, short])
    h = range_hashes(token, lo, hi)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(counts) + 1))


def sketch(h: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """One row of t coordinates for each set; an empty set keeps the all-ones value everywhere."""
    n = len(bounds) - 1
    out = np.full(n * t, _EMPTY)
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(n), sizes)
    unfilled = sizes > 0
    low = np.uint64(0xFFFFFFFF)
    for i in range(2 * t):
        if not unfilled.any():
            break
        x = mix(h + np.uint64(((i + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        place = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, row * t + place, (np.uint64(i) << np.uint64(32)) | (x & low))
        full = (out.reshape(n, t)[unfilled] != _EMPTY).all(1)
        if full.any():
            unfilled[np.flatnonzero(unfilled)[full]] = False
            keep = unfilled[row]
            h, row = h[keep], row[keep]
    return out.reshape(n, t)


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    n = len(coordinates)
    v = coordinates[:, : bands * rows].reshape(n * bands, rows)
    key = np.tile(np.arange(bands, dtype=np.uint64), n)
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + v[:, j])
    return key.reshape(n, bands)


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                h, bounds = shingle_sets(part, k)
                sizes = np.diff(bounds)
                keys = band_keys(sketch(h, bounds, bands * rows), bands, rows)
                sums = np.zeros((2, len(h) + 1), np.uint64)
                np.cumsum(mix(h), out=sums[0, 1:])
                np.cumsum(mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), out=sums[1, 1:])
                sig = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]).astype(np.int64)
                flat = pa.array(keys.reshape(-1).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.rows.start, len(part)),
                        pa.array(sizes),
                        pa.array(sig[0]),
                        pa.array(sig[1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * bands), flat),
                    ],
                    names=["id", "n", "sig1", "sig2", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                h, bounds = shingle_sets(part, k)
                raw = pa.py_buffer(h.tobytes())
                blob = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((bounds * 8).astype(np.int32).tobytes()), raw])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.rows.start, len(part)), blob], names=["id", "items"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = []
            for i in range(batch.num_rows):
                a = np.frombuffer(left[i].as_buffer(), np.uint64)
                b = np.frombuffer(right[i].as_buffer(), np.uint64)
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(good, pa.bool_())) for c in (batch.column(0), batch.column(1))], names=["src", "dst"]
            )

    return run


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, through blocks of shared items."""
    sizes = np.array([len(x) for x in left + right])
    item, inverse, count = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.cumsum(count > 1) - 1
    shared = count[inverse] > 1
    row, column = row[shared], column[inverse[shared]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        block = np.zeros((len(sizes), 4096), np.float32)
        block[row[a:b], column[a:b] - at] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return out


def _tile_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between components among (tile, id, component, items); one link for each join of components."""
    low = min(r[0] for r in rows)
    left = [r for r in rows if r[0] == low]
    right = [r for r in rows if r[0] != low] or left
    sizes = [np.array([len(r[3]) for r in x]) for x in (left, right)]
    both = _intersections([r[3] for r in left], [r[3] for r in right])
    near = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
    parts = [np.array([r[2] for r in x]) for x in (left, right)]
    near &= parts[0][:, None] != parts[1][None, :]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for i, j in np.argwhere(near):
        a, b = find(left[i][2]), find(right[j][2])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((left[i][1], right[j][1]))
    return out


def _tiles(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            links = _tile_links(rows, percent) if len({r[2] for r in rows}) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["src", "dst"])

        for batch in batches:
            head = list(zip(*(batch.column(i).to_pylist() for i in range(6))))
            items = batch.column(6)
            for i, (hub, p, q, tile, id_, c) in enumerate(head):
                if (hub, p, q) != key:
                    yield from done()
                    key, rows = (hub, p, q), []
                rows.append((tile, id_, c, np.frombuffer(items[i].as_py(), np.uint64)))
        yield from done()

    return run


TILE = 256


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = 40,
    rows: int = 6,
) -> DataFrame:
    """Group documents whose sets of lower-cased word shingles have a Jaccard of percent / 100 or more.

    Returns (id, n_shingles, component_id, kept): one row for each input row, component_id the
    smallest id reachable by links, kept where the two are equal. A text with fewer than
    shingle_words words has its whole word sequence as one shingle; null and blank texts have an
    empty set and link with nothing. Rows with a null id are left out. Rows that repeat an id are
    one node with the links of all of them. Other columns are ignored.

    With 40 bands of 6 rows a pair at exactly 0.8 is missed with probability 5e-6, at 0.85 with 2e-9.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    sketched = written(source.mapInArrow(trimmed(_sketches(shingle_words, bands, rows)), "id long, n long, sig1 long, sig2 long, bands array<long>"))
    full = sketched.filter("n > 0")
    classes = full.groupBy("n", "sig1", "sig2").agg(F.min("id").alias("rep"), F.count("*").alias("members")).filter("members > 1")
    members = join_groups(full.select("id", "n", "sig1", "sig2"), classes, ["n", "sig1", "sig2"], "members", sketched.count())
    copies = written(members.filter("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst")))
    entries = (
        full.join(copies.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
        .select("id", F.explode("bands").alias("key"))
    )
    hubs = entries.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).filter("hub < top").select("key", "hub")
    buckets = written(entries.join(hubs, "key"))
    stars = written(buckets.filter("id > hub").select(F.col("id").alias("src"), F.col("hub").alias("dst")).distinct())
    nodes = stars.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    sets = written(source.join(nodes.hint("merge"), "id", "left_semi").mapInArrow(trimmed(_sets(shingle_words)), "id long, items binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("id").alias("src"), F.col("items").alias("a"))
        b = sets.select(F.col("id").alias("dst"), F.col("items").alias("b"))
        both = pairs.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").select("src", "dst", "a", "b")
        return both.mapInArrow(trimmed(_verify(percent)), "src long, dst long")

    links = written(confirmed(stars))
    found = written(connected_components(links))
    # Members of one bucket that are still apart: only these are compared with each other.
    places = found.withColumnRenamed("node", "id").hint("merge")
    placed = buckets.join(places, "id", "left").select("key", "hub", "id", F.coalesce("component", "id").alias("c"))
    split = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    apart = written(placed.join(split, "key").select("hub", "id", "c").distinct())
    total = apart.count()
    # Members that are in the hub's component are dealt to tiles of their own, which never meet one another.
    home = F.max(F.when(F.col("id") == F.col("hub"), F.col("c")))
    homes = apart.groupBy("hub").agg(home.alias("home"), F.count("*").alias("n"))
    inner = join_groups(apart, homes, ["hub"], "n", total).withColumn("inside", F.coalesce(F.col("c") == F.col("home"), F.lit(False))).select("hub", "id", "c", "inside")
    inside = F.count(F.when(F.col("inside"), 1))
    tiles = inner.groupBy("hub").agg(F.ceil(inside / TILE).cast("int").alias("tp"), F.ceil((F.count("*") - inside) / TILE).cast("int").alias("tq"), F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("id"), F.when(F.col("inside"), F.col("tp")).otherwise(F.col("tq"))).cast("int")
    dealt = join_groups(inner, tiles, ["hub"], "n", total).withColumn("tile", place + F.when(F.col("inside"), 0).otherwise(F.col("tp")))
    others = F.sequence(F.when(F.col("inside"), F.col("tp")).otherwise(0), F.col("tp") + F.col("tq") - 1)
    dealt = dealt.filter("tq > 0").withColumn("other", F.explode(others))
    dealt = dealt.select("hub", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "id", "c")
    dealt = dealt.join(sets.hint("merge"), "id").select("hub", "p", "q", "tile", "id", "c", "items")
    dealt = dealt.repartition("hub", "p", "q").sortWithinPartitions("hub", "p", "q")
    more = written(dealt.mapInArrow(_tiles(percent), "src long, dst long"))
    for done in (buckets, stars, sets, found, apart):
        release(done)
    groups = connected_components(links.union(more).union(copies))
    out = sketched.select("id", "n").join(groups.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle_words=4, percent=80).withColumnRenamed("id", "doc_id")


OP2_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
         else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as a, doc_id as b from w union select r.a, e.b from r join e on r.b = e.a),
c as (select a as doc_id, min(b) as component_id from r group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, w.doc_id = c.component_id as kept
from w join c on c.doc_id = w.doc_id left join n on n.doc_id = w.doc_id
"""
