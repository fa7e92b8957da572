"""Blocks (parts that no single node cuts) of undirected graphs by auxiliary components over a spanning tree.

A breadth-first tree is grown in every weak component. Each edge outside it is walked up from both ends to where
they meet; the least depth at which an edge from below v meets tells whether v's tree edge and its parent's lie on one cycle. Tree edges tied by
that, and those of the two ends of each other edge, are tied together, and the components of the ties are the blocks. All tables
have a row for each node or edge; a round reads the nodes of one level or the edges not yet met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Hubs, cut, simple, weak_components

MERGE = 32  # appended fronts after which they become one table, which keeps plans short


class Appended:
    """A table that grows by fronts, each written once."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > MERGE:
            self.parts = [cut(self.all())]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out


def both_ways(edges: DataFrame) -> DataFrame:
    e = simple(edges)
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def spanning_tree(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """((node, up, depth, component) of all nodes, the edges both ways, number of levels): breadth first from the least node of each component."""
    both = cut(both_ways(edges))
    parts = cut(weak_components(nodes, edges))
    kind = parts.schema["id"].dataType
    front = cut(parts.filter("id = component").select(F.col("id").alias("node"), F.lit(None).cast(kind).alias("up"), F.lit(0).alias("depth")))
    before, tree, depth = front.limit(0), Appended(front), 0
    hubs = Hubs(both, "src")
    while True:
        depth += 1
        step = hubs.join(front.select(F.col("node").alias("src")), both).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("up"))
        # A neighbour of a level is in it, in the one before, or new.
        fresh = cut(step.join(front.select("node").union(before.select("node")), "node", "left_anti").select("node", "up", F.lit(depth).alias("depth")))
        if fresh.isEmpty():
            break
        tree.add(fresh)
        before, front = front, fresh
    whole = tree.all().join(parts.select(F.col("id").alias("node"), "component"), "node")
    return cut(whole), both, depth


def _meetings(tree: DataFrame, both: DataFrame) -> DataFrame:
    """(a, b, met) of edges outside the tree: the depth of the lowest node above both ends."""
    used = tree.filter("up is not null").select(F.least("node", "up").alias("a"), F.greatest("node", "up").alias("b"))
    rest = both.filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(used, ["a", "b"], "left_anti")
    x = tree.select(F.col("node").alias("a"), F.col("depth").alias("da"), F.col("up").alias("ua"))
    y = tree.select(F.col("node").alias("b"), F.col("depth").alias("db"), F.col("up").alias("ub"))
    ends = rest.join(x, "a").join(y, "b")
    # The deeper end takes one step, so that both stand on one level.
    at = ends.select("a", "b", F.when(F.col("da") > F.col("db"), F.col("ua")).otherwise(F.col("a")).alias("x"), F.when(F.col("db") > F.col("da"), F.col("ub")).otherwise(F.col("b")).alias("y"), F.least("da", "db").alias("met"))
    at = cut(at)
    done = Appended(at.filter("x = y").select("a", "b", "met"))
    step = tree.select(F.col("node").alias("x"), F.col("up").alias("nx")), tree.select(F.col("node").alias("y"), F.col("up").alias("ny"))
    at = at.filter("x <> y")
    while not at.isEmpty():
        at = cut(at.join(step[0], "x").join(step[1], "y").select("a", "b", F.col("nx").alias("x"), F.col("ny").alias("y"), (F.col("met") - 1).alias("met")))
        done.add(at.filter("x = y").select("a", "b", "met"))
        at = at.filter("x <> y")
    return cut(done.all())


def blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, up, depth, component, size, low, block) of all nodes; directions, self loops and repeats don't matter.

    up is the parent in the spanning tree (null at roots), size the nodes below and at the node, low the
    least depth at which an edge that leaves the tree there meets (null without any), block the name of
    the block that the edge to the parent lies in (null at roots).
    """
    tree, both, levels = spanning_tree(nodes, edges)
    rest = _meetings(tree, both)
    own = rest.select(F.col("a").alias("node"), "met").union(rest.select("b", "met")).groupBy("node").agg(F.min("met").alias("low"))
    state = cut(tree.join(own, "node", "left").withColumn("size", F.lit(1).cast("long")))
    below, done = None, None
    for level in range(levels - 1, -1, -1):
        here = state.filter(F.col("depth") == level)
        if below is not None:
            here = here.join(below, "node", "left").select("node", "up", "depth", "component", F.least("low", "_low").alias("low"), (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"))
        here = cut(here)
        below = here.groupBy(F.col("up").alias("node")).agg(F.min("low").alias("_low"), F.sum("size").alias("_size"))
        done = done or Appended(here.limit(0))
        done.add(here)
    if done is None:
        return state.withColumn("block", F.col("up"))
    whole = cut(done.all())
    ties = whole.filter("depth > 1 and low < depth - 1").select(F.col("node").alias("src"), F.col("up").alias("dst"))
    ties = ties.union(rest.select("a", "b"))
    tied = weak_components(whole.filter("up is not null").select(F.col("node").alias("id")), ties)
    return whole.join(tied.select(F.col("id").alias("node"), F.col("component").alias("block")), "node", "left").select("node", "up", "depth", "component", "size", "low", "block")


def cut_nodes(table: DataFrame) -> DataFrame:
    """(id): nodes of a blocks() table whose tree edges lie in two blocks or more; without them their component falls apart."""
    edges = table.filter("up is not null")
    sides = edges.select(F.col("node").alias("id"), "block").union(edges.select("up", "block")).distinct()
    return sides.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")


def cut_edges(table: DataFrame) -> DataFrame:
    """(node, up, size, rest): tree edges of a blocks() table that no other edge spans, with the nodes on the lower and the other side."""
    sizes = table.filter("up is null").select("component", F.col("size").alias("n"))
    return table.filter("up is not null and (low is null or low >= depth)").join(sizes, "component").select("node", "up", "size", (F.col("n") - F.col("size")).alias("rest"))


def articulation(edges: DataFrame) -> DataFrame:
    """(id): nodes without which their component falls apart, as cut_nodes(blocks()) gives them.

    Trees are taken off first, leaf by leaf: a leaf and its holder are cut nodes where they have two neighbours or more in the
    whole graph. Blocks are sought in what is left, nodes on cycles and between them.
    """
    left = cut(both_ways(edges))
    several = left.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id")
    ends = None
    while True:
        leaves = cut(left.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("holder")).filter("n = 1").select("id", "holder"))
        if leaves.isEmpty():
            break
        ends = ends or Appended(leaves.select("id").limit(0))
        ends.add(leaves.select(F.explode(F.array("id", "holder")).alias("id")))
        gone = leaves.select("id")
        left = cut(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    core = cut_nodes(blocks(left.select(F.col("src").alias("id")).distinct(), left))
    return core if ends is None else core.union(several.join(ends.all(), "id", "left_semi")).distinct()
