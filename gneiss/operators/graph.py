"""Measures of directed graphs given as edge tables (src, dst): joins to a fixed point, never a collected graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.stats import ratio, ratio_or_null

#: Written tables of more rows are never broadcast, however small their files are.
BROADCAST_ROWS = 20_000


def cut(df: DataFrame) -> DataFrame:
    """Write df once in the folder that all executors share and read it back; a folder of our own only where a local session names none.

    A checkpoint would keep the size that was guessed for the plan behind it. In a loop these guesses multiply with
    every join, until planning itself takes minutes; a table that is read has the size of its files. That size is a
    small part of the rows' where ids are packed well, so of a table with over BROADCAST_ROWS rows no join makes a broadcast.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gneiss-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/gneiss-cuts/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.hint("merge") if seen.get["n"] > BROADCAST_ROWS else out


class Hubs:
    """Joins of a table with a row for each node to the edges of one end, where a few nodes may have a large share of them.

    Nodes with LEAST edges and a hundred-thousandth of all (so 100,000 nodes at most) are hubs: their edges are
    dealt over a task for each LEAST of them, and the row of the node goes to each of these.
    """

    LEAST = 100_000

    def __init__(self, edges: DataFrame, end: str):
        self.end = end
        counts = edges.groupBy(end).agg(F.count("*").alias("_n"))
        least = max(self.LEAST, edges.count() // 100_000)
        self.hubs = counts.filter(F.col("_n") >= least).select(end, F.ceil(F.col("_n") / self.LEAST).cast("int").alias("_parts"))
        self.some = not self.hubs.isEmpty()
        if self.some:
            self.hubs = F.broadcast(cut(self.hubs))

    def join(self, table: DataFrame, edges: DataFrame) -> DataFrame:
        """table ⋈ edges on the end; table has one row a node."""
        if not self.some:
            return table.join(edges, self.end)
        salt = F.pmod(F.xxhash64(*edges.columns), F.coalesce("_parts", F.lit(1))).cast("int")
        dealt = edges.join(self.hubs, self.end, "left").withColumn("_salt", salt).drop("_parts")
        copies = table.join(self.hubs, self.end, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        return copies.join(dealt, [self.end, "_salt"]).drop("_salt")


def simple(edges: DataFrame) -> DataFrame:
    """Edges without self loops and repeats."""
    return edges.select("src", "dst").filter("src <> dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, role) of every node: source, sink, isolated or inner."""
    e = simple(edges)
    fan_in, fan_out = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in")), e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    out = nodes.select("id").join(fan_in, "id", "left").join(fan_out, "id", "left").na.fill(0, ["fan_in", "fan_out"])
    role = F.when((F.col("fan_in") == 0) & (F.col("fan_out") == 0), "isolated").when(F.col("fan_in") == 0, "source").when(F.col("fan_out") == 0, "sink").otherwise("inner")
    return out.withColumn("role", role)


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges and their share of all ordered pairs (null below two nodes)."""
    n, e = nodes.agg(F.count("*").alias("nodes")), simple(edges).agg(F.count("*").alias("edges"))
    return n.join(e).select("nodes", "edges", ratio_or_null(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"))


def closure(edges: DataFrame, distance: bool = False) -> DataFrame:
    """(src, dst) for every dst that src reaches by one or more edges, src itself left out; with the hop count on demand.

    Semi-naive: each round joins only the pairs found in the round before, drops known ones and
    checkpoints the new ones alone; cycles end because no new pair appears. The result has a row for
    each linked pair: measures that need no pairs (components, layers, cycles) have ways of their own.
    """
    e = cut(simple(edges))
    found = front = e.withColumn("hops", F.lit(1))
    hops = 1
    while True:
        hops += 1
        step = front.select("src", F.col("dst").alias("via")).join(e.select(F.col("src").alias("via"), "dst"), "via").filter("src <> dst")
        fresh = step.select("src", "dst").distinct().join(found, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops))
        front = cut(fresh)
        if front.isEmpty():
            break
        found = found.union(front)
        if hops % 16 == 0:  # keeps the plan short
            found = cut(found)
    return found if distance else found.select("src", "dst")


def reach_counts(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """(id, dependencies, dependents, reach_share): how many nodes each reaches and is reached by."""
    down = reach.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("dependencies"))
    up = reach.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("dependents"))
    n = nodes.agg(F.count("*").alias("_n"))
    out = nodes.select("id").join(down, "id", "left").join(up, "id", "left").na.fill(0).join(F.broadcast(n))  # one row
    return out.select("id", "dependencies", "dependents", ratio(F.col("dependents"), F.col("_n") - 1).alias("reach_share"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, size): component is the smallest node that reaches and is reached.

    Nodes without an edge in or out are on no cycle and are taken off first, over and over. In the
    rest every node takes the smallest id that reaches it; those that reach that id back, inside its
    colour, are its component and are taken off too. No pair of nodes is ever listed.
    """
    left = cut(simple(edges))
    done = None
    while not left.isEmpty():
        while True:  # trim
            kept = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        colour = cut(left.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id")))
        while True:
            low = left.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            after = cut(colour.join(low, "id", "left").select("id", F.least("c", "m").alias("c"), F.col("c").alias("was")))
            colour = after.select("id", "c")
            if after.filter("c <> was").isEmpty():
                break
        inner = left.join(colour.select(F.col("id").alias("src"), "c"), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("d")), "dst").filter("c = d").select("src", "dst", "c")
        inner = cut(inner)
        found = front = cut(colour.filter("id = c"))
        while True:
            step = inner.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "c").distinct()
            front = cut(step.join(found, "id", "left_anti"))
            if front.isEmpty():
                break
            found = cut(found.union(front))
        done = found if done is None else done.union(found)
        gone = found.select("id")
        left = cut(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    out = nodes.select("id").distinct()
    if done is None:
        return out.select("id", F.col("id").alias("component"), F.lit(1).cast("long").alias("size"))
    sizes = done.groupBy("c").agg(F.count("*").alias("n"))
    out = out.join(done.join(sizes, "c"), "id", "left")
    return out.select("id", F.coalesce("c", "id").alias("component"), F.coalesce("n", F.lit(1)).alias("size"))


def condensation(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges between components."""
    c = components.select("id", "component")
    e = simple(edges).join(c.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
    return simple(e.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def layers(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, layer): longest path from the component down to one without dependencies.

    A round keeps the edges into components that have an edge down themselves, so the edges of a round are those of the
    layers above it; layers are put together once, at the end.
    """
    left = cut(condensation(edges, components))
    level = components.select(F.col("component").alias("c")).distinct().withColumn("layer", F.lit(0))
    step = 0
    while not left.isEmpty():
        step += 1
        level = level.union(left.select(F.col("src").alias("c")).distinct().withColumn("layer", F.lit(step)))
        left = cut(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if step % 32 == 0:  # keeps the plan short
            level = cut(level.groupBy("c").agg(F.max("layer").alias("layer")))
    level = level.groupBy("c").agg(F.max("layer").alias("layer"))
    return components.join(level.withColumnRenamed("c", "component"), "component").select("id", "component", "layer")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): component is the smallest node tied to it in either direction; edges with an end outside the nodes don't count.

    Randomised contraction: in a round every node moves to the one of least hash among itself and its neighbours, and the edges
    move along; each round has a hash of its own. Nodes with edges become at least a quarter fewer in the mean, whatever the graph, so
    all rounds together read a few times the edges. Nodes without edges are in no round.
    """
    ids = nodes.select("id").distinct()
    pair = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    e = edges.filter("src <> dst").select(*pair).distinct()
    for end in ("src", "dst"):
        e = e.join(ids.withColumnRenamed("id", end), end, "left_semi")
    e = cut(e.select("src", "dst"))
    moves, n = [], e.count()
    while n:
        a, b = (F.xxhash64(F.lit(len(moves)), F.col(end)) for end in ("src", "dst"))
        ends = e.select("src", "dst", a.alias("a"), b.alias("b")).select(F.explode(F.array("src", "dst")).alias("id"), F.expr("if(a <= b, src, dst)").alias("to"), F.least("a", "b").alias("h"))
        move = cut(ends.groupBy("id").agg(F.min_by("to", "h").alias("to")))
        hubs = [Hubs(e, end) if n >= Hubs.LEAST else None for end in ("src", "dst")]  # no hub has more edges than there are
        for end, hub in zip(("src", "dst"), hubs):
            at = move.select(F.col("id").alias(end), F.col("to").alias(f"{end}_to"))
            e = at.join(e, end) if hub is None else hub.join(at, e)
        e = cut(e.select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).filter("src <> dst").select(*pair).distinct())
        moves.append(move)
        n = e.count()
    if not moves:
        return ids.select("id", F.col("id").alias("component"))
    last = moves.pop()
    while moves:
        last = moves.pop().join(last.select(F.col("id").alias("to"), F.col("to").alias("then")), "to", "left").select("id", F.coalesce("then", "to").alias("to"))
    last = cut(last)
    names = last.groupBy("to").agg(F.min("id").alias("component"))
    return cut(ids.join(last.join(names, "to").select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component")))


def owner_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges between the owners of nodes with their number; edges inside one owner go."""
    o = owners.select("id", "owner")
    e = edges.join(o.select(F.col("id").alias("src"), F.col("owner").alias("from")), "src").join(o.select(F.col("id").alias("dst"), F.col("owner").alias("to")), "dst")
    return e.filter(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.count("*").alias("edges"))


def would_cycle(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed edges that close a cycle: to themselves, or where dst already reaches src.

    Searched from the proposed ends only, and each is given up once it is found.
    """
    e = cut(simple(edges))
    asked = cut(proposed.select("src", "dst").distinct())
    found = asked.filter("src = dst")
    seen = front = asked.filter("src <> dst").select("src", "dst", F.col("dst").alias("at"))
    while True:
        step = front.join(e.select(F.col("src").alias("at"), F.col("dst").alias("to")), "at").select("src", "dst", F.col("to").alias("at")).distinct()
        step = cut(step.join(seen, ["src", "dst", "at"], "left_anti"))
        if step.isEmpty():
            break
        hit = step.filter("at = src").select("src", "dst")
        found = cut(found.union(hit))
        front = step.join(hit, ["src", "dst"], "left_anti")
        seen = cut(seen.union(step))
    return proposed.join(found, ["src", "dst"], "left_semi")
