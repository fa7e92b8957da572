"""Connected components by alternating large-star and small-star rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import HOT_GROUPS, join_salted
from .store import release, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without a link are not returned.

    Every round aggregates neighbours to their minimum and joins that minimum back, so no node's
    neighbour list is ever gathered, nor do the links of a hub meet in one task; self links, nulls,
    repeated and reversed links are harmless.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u > v").distinct()
    e = written(e)
    seen = _mark(e)
    while True:
        hub = max(64, 2 * seen[0] // HOT_GROUPS)  # at most HOT_GROUPS nodes have as many links
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = join_salted(both.filter("v > u"), low, ["u"], "n", hub).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_salted(large, low, ["u"], "n", hub).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        after = written(small)
        release(e)
        e, mark = after, _mark(after)
        if mark == seen:
            break
        seen = mark
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("max(xxhash64(v, u))")).first())
