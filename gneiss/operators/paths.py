"""Measures over shortest paths and cuts of a directed graph, level by level as joins; no graph is ever collected.

Every round joins one level to the edges and is checkpointed, so a task holds its share of rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..policy import DEFAULT, Policy
from .blocks import articulation, blocks, cut_edges
from .graph import condensation, cut, layers, simple


def shortest_counts(edges: DataFrame) -> DataFrame:
    """(src, dst, hops, paths): distance and number of shortest paths of every pair that is linked, src = dst left out."""
    e = cut(simple(edges))
    found = front = e.select("src", "dst", F.lit(1).alias("hops"), F.lit(1.0).alias("paths"))
    hops = 1
    while True:
        hops += 1
        step = front.select("src", F.col("dst").alias("via"), "paths").join(e.select(F.col("src").alias("via"), "dst"), "via").filter("src <> dst")
        step = step.groupBy("src", "dst").agg(F.sum("paths").alias("paths")).join(found, ["src", "dst"], "left_anti")
        front = cut(step.select("src", "dst", F.lit(hops).alias("hops"), "paths"))
        if front.isEmpty():
            return found
        found = cut(found.union(front))


def betweenness(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, betweenness) of nodes and (src, dst, betweenness) of edges: the shares of all pairs' shortest paths through each.

    Nodes are normalised by (n - 1)(n - 2), edges by n (n - 1). What a pair owes to the nodes before
    its end is summed back from the farthest level to the nearest, for all sources at once.
    """
    e = cut(simple(edges))
    found = cut(shortest_counts(edges))
    most = found.agg(F.max("hops")).first()[0] or 0
    n = nodes.select("id").distinct().count()
    # Edges on shortest paths: from v at one distance of s to w at the next; s itself is at distance 0.
    near = found.select("src", F.col("dst").alias("v"), F.col("hops").alias("hv"), F.col("paths").alias("pv"))
    near = near.union(e.select("src", F.col("src").alias("v"), F.lit(0), F.lit(1.0)).distinct())
    steps = near.join(e.select(F.col("src").alias("v"), F.col("dst").alias("w")), "v").join(found.select("src", F.col("dst").alias("w"), F.col("hops").alias("hw"), F.col("paths").alias("pw")), ["src", "w"])
    steps = cut(steps.filter("hw = hv + 1").select("src", "v", "w", "hw", (F.col("pv") / F.col("pw")).alias("share")))
    owed = shares = None
    for hops in range(most, 0, -1):
        level = steps.filter(F.col("hw") == hops)
        if owed is None:
            level = level.select("src", "v", "w", F.col("share").alias("part"))
        else:
            level = level.join(owed.withColumnRenamed("v", "w"), ["src", "w"], "left").select("src", "v", "w", (F.col("share") * (1 + F.coalesce("owed", F.lit(0.0)))).alias("part"))
        level = cut(level)
        owed = level.groupBy("src", "v").agg(F.sum("part").alias("owed"))
        one = level.select("src", "v", "w", "part")
        shares = one if shares is None else shares.union(one)
    if shares is None:
        return nodes.select("id", F.lit(0.0).alias("betweenness")).distinct(), e.select("src", "dst", F.lit(0.0).alias("betweenness"))
    shares = cut(shares)
    by_node = shares.filter("v <> src").groupBy(F.col("v").alias("id")).agg(F.sum("part").alias("b"))
    by_edge = shares.groupBy(F.col("v").alias("src"), F.col("w").alias("dst")).agg(F.sum("part").alias("b"))
    scale = (n - 1) * (n - 2)
    on_nodes = nodes.select("id").distinct().join(by_node, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) / scale if scale > 0 else F.lit(0.0)).alias("betweenness"))
    return on_nodes, e.join(by_edge, ["src", "dst"], "left").select("src", "dst", (F.coalesce("b", F.lit(0.0)) / (n * (n - 1))).alias("betweenness"))


def corridors(edges: DataFrame, policy: Policy = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(corridor, length, support) and the pairs (src, dst) left out because they have too many shortest paths.

    A corridor is a run of nodes, corridor_length edges or longer, on shortest paths of at least
    corridor_support pairs that is part of no longer one. Pairs nearer than that length have no say.
    """
    e = cut(simple(edges))
    found = cut(shortest_counts(edges))
    kept = cut(found.filter(F.col("paths") <= policy.corridor_paths))
    front = e.select("src", "dst", F.array("src", "dst").alias("path"))
    runs = None
    hops = 1
    while True:
        hops += 1
        nxt = front.select("src", F.col("dst").alias("via"), "path").join(e.select(F.col("src").alias("via"), "dst"), "via")
        nxt = nxt.join(kept.filter(F.col("hops") == hops).select("src", "dst"), ["src", "dst"], "left_semi")
        front = cut(nxt.select("src", "dst", F.array_append("path", F.col("dst")).alias("path")))
        if front.isEmpty():
            break
        if hops >= policy.corridor_length:
            runs = front if runs is None else runs.union(front)
    capped = found.filter((F.col("paths") > policy.corridor_paths) & (F.col("hops") >= policy.corridor_length)).select("src", "dst")
    if runs is None:
        runs = front
    size, least = F.size("path"), policy.corridor_length + 1
    spans = F.expr(f"flatten(transform(sequence(1, size(path) - {least - 1}), a -> transform(sequence({least}, size(path) - a + 1), n -> slice(path, a, n))))")
    parts = runs.filter(size >= least).select("src", "dst", F.explode(spans).alias("run")).distinct()
    support = cut(parts.groupBy("run").agg(F.count("*").alias("pairs")).filter(F.col("pairs") >= policy.corridor_support))
    # A run within a longer one is also that one less its first or its last node, or within that.
    shorter = support.select(F.explode(F.array(F.expr("slice(run, 1, size(run) - 1)"), F.expr("slice(run, 2, size(run) - 1)"))).alias("run"))
    whole = support.join(shorter, "run", "left_anti")
    return whole.select(F.array_join(F.col("run").cast("array<string>"), "→").alias("corridor"), (F.size("run") - 1).alias("length"), F.col("pairs").alias("support")), capped


def longest_chains(components: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(chain, length): the first k of the longest ways down from components nothing depends on, deepest start first, then by ids.

    A component with several members is written [a|b]. At most k partial ways are kept each round:
    every one of them ends, and their order never changes.
    """
    dag = cut(condensation(edges, components))
    depth = cut(layers(components, edges).select(F.col("component").alias("c"), "layer").distinct())
    starts = depth.filter("layer > 0").join(dag.select(F.col("dst").alias("c")).distinct(), "c", "left_anti")
    ways = cut(starts.orderBy(F.desc("layer"), "c").limit(k).select(F.col("layer").alias("top"), F.col("layer").alias("left"), F.col("c").alias("at"), F.array("c").alias("path")))
    steps = dag.join(depth.select(F.col("c").alias("dst"), "layer"), "dst").select(F.col("src").alias("at"), "dst", "layer")
    while not ways.filter("left > 0").isEmpty():
        on = ways.join(steps.withColumnRenamed("layer", "l"), "at", "left").filter((F.col("left") == 0) | (F.col("l") == F.col("left") - 1))
        more = F.col("left") > 0
        on = on.select("top", F.when(more, F.col("left") - 1).otherwise(0).alias("left"), F.when(more, F.col("dst")).otherwise(F.col("at")).alias("at"), F.when(more, F.array_append("path", F.col("dst"))).otherwise(F.col("path")).alias("path"))
        ways = cut(on.distinct().orderBy(F.desc("top"), "path").limit(k))
    places = ways.withColumn("way", F.monotonically_increasing_id()).select("way", "path", "top", F.posexplode("path").alias("n", "component"))
    members = components.join(places.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("m"))
    label = F.when(F.size("m") > 1, F.concat(F.lit("["), F.array_join(F.col("m").cast("array<string>"), "|"), F.lit("]"))).otherwise(F.col("component").cast("string"))
    named = places.join(members, "component").groupBy("way", "top").agg(F.array_sort(F.collect_list(F.struct("n", label.alias("x")))).alias("xs"))
    return named.select(F.array_join(F.col("xs.x"), "→").alias("chain"), (F.col("top") + 1).alias("length"))


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, src_side, dst_side) of edges whose removal parts their weak component, with the sizes of both parts."""
    e = simple(edges)
    alone = cut_edges(blocks(nodes, e))
    down = alone.select(F.col("up").alias("src"), F.col("node").alias("dst"), F.col("rest").alias("src_side"), F.col("size").alias("dst_side"))
    either = down.union(alone.select("node", "up", "size", "rest"))
    # An edge with its reverse beside it parts nothing.
    single = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
    return single.join(either, ["src", "dst"])


def edge_structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, routes, severed, bridge, src_side, dst_side) of every edge.

    routes counts the other nodes src depends on that still reach dst without the edge; severed the
    ordered pairs besides its own that only the edge lets reach each other (none where a route is
    left); bridge is true if the weak component falls apart, the sides are then the sizes of both parts, else 0.
    """
    e = cut(simple(edges))
    step = e.select(F.col("src").alias("x"), F.col("dst").alias("y"))

    def spread(start: DataFrame, keys: list[str]) -> DataFrame:
        """All (keys, node) reached from start over edges other than the key edge (src, dst), start included."""
        found = front = cut(start.distinct())
        while True:
            on = front.withColumnRenamed("node", "x").join(step, "x").filter("not (x = src and y = dst)").select(*keys, F.col("y").alias("node")).distinct()
            front = cut(on.join(found, [*keys, "node"], "left_anti"))
            if front.isEmpty():
                return found
            found = cut(found.union(front))

    hops = e.join(e.select("src", F.col("dst").alias("hop")), "src").filter("hop <> dst").select("src", "dst", "hop")
    reached = spread(hops.select("src", "dst", "hop", F.col("hop").alias("node")), ["src", "dst", "hop"]).filter("node = dst").select("src", "dst", "hop").distinct()
    routes = cut(reached.groupBy("src", "dst").agg(F.count("*").alias("routes")))
    only = cut(e.join(routes, ["src", "dst"], "left_anti"))
    # Sources above an edge without another route, and what they reach with and without it.
    back = step.select(F.col("y").alias("x"), F.col("x").alias("y"))
    above = front = cut(only.select("src", "dst", F.col("src").alias("node")))
    after = front_after = cut(only.select("src", "dst", F.col("dst").alias("node")))
    while not front.isEmpty():
        on = front.withColumnRenamed("node", "x").join(back, "x").select("src", "dst", F.col("y").alias("node")).distinct()
        front = cut(on.join(above, ["src", "dst", "node"], "left_anti"))
        above = cut(above.union(front))
    while not front_after.isEmpty():
        on = front_after.withColumnRenamed("node", "x").join(step, "x").select("src", "dst", F.col("y").alias("node")).distinct()
        front_after = cut(on.join(after, ["src", "dst", "node"], "left_anti"))
        after = cut(after.union(front_after))
    still = spread(above.select("src", "dst", F.col("node").alias("a"), "node"), ["src", "dst", "a"])
    lost = above.withColumnRenamed("node", "a").join(after, ["src", "dst"]).filter("a <> node").join(still, ["src", "dst", "a", "node"], "left_anti")
    severed = lost.groupBy("src", "dst").agg((F.count("*") - 1).alias("severed"))
    out = e.join(routes, ["src", "dst"], "left").join(severed, ["src", "dst"], "left").join(bridges(nodes, e), ["src", "dst"], "left")
    zero = F.lit(0).cast("long")
    return out.select("src", "dst", *[F.coalesce(c, zero).alias(c) for c in ("routes", "severed")], F.col("src_side").isNotNull().alias("bridge"), *[F.coalesce(c, zero).alias(c) for c in ("src_side", "dst_side")])


def articulation_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id) whose removal leaves more weak components: those in two blocks or more."""
    return articulation(edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"))
