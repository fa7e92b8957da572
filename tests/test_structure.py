"""Structure operators on small hand-made graphs and tables."""

from pyspark.sql import functions as F

from gneiss.operators import graph, paths, structure


def test_longest_prefix_owner(spark):
    paths = spark.createDataFrame([("a/b/c",), ("a/bc",), ("z",)], "path string")
    roots = spark.createDataFrame([("a", "A"), ("a/b", "B")], "root string, owner string")
    assert {r.path: r.owner for r in structure.longest_prefix_owner(paths, roots).collect()} == {"a/b/c": "B", "a/bc": "A", "z": None}


def test_seams_split_the_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("c", "x")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "id string")

    def seams(e):
        return structure.seams(paths.edge_structure(nodes, e), paths.betweenness(nodes, e)[1]).collect()

    rows = seams(edges)
    assert [r.severed for r in rows] == sorted((r.severed for r in rows), reverse=True)
    assert {(r.src, r.dst, r.severed, r.src_side, r.dst_side) for r in rows if r.bridge} == {("c", "x", 8, 3, 3)}
    two = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert seams(two) == []


def test_foundations_group_by_equal_members(spark):
    reach = spark.createDataFrame([("a", "k", 1), ("b", "k", 2), ("a", "m", 1), ("b", "m", 1), ("a", "solo", 1)], "src string, dst string, hops int")
    uses = spark.createDataFrame([("a", "k", 0)], "src string, dst string, uses int")
    members, groups = structure.foundations(reach, uses)
    assert {(r.dst, r.src): r.weight for r in members.collect()} == {("k", "a"): 1.0, ("k", "b"): 0.5, ("m", "a"): 1.0, ("m", "b"): 1.0}
    assert [tuple(r) for r in groups.collect()] == [("k", 2, 2)]


def test_lock_lookup_takes_the_nearest(spark):
    lock = spark.createDataFrame([("", "d", "1"), ("p", "d", "2"), ("q", "d", "3")], "at string, name string, version string")
    asked = spark.createDataFrame([("p/x", "d"), ("r", "d"), ("p", "none")], "locator string, name string")
    assert {(r.locator, r.name): r.version for r in structure.lock_lookup(asked, lock).collect()} == {("p/x", "d"): "2", ("r", "d"): "1", ("p", "none"): None}


def test_fan_cutoffs_without_positive_values(spark):
    df = spark.createDataFrame([("p", 0), ("q", 9), ("q", 1)], "k string, v int")
    assert {r.k: r.cutoff for r in structure.fan_cutoffs(df, "k", "v").collect()} == {"p": float("inf"), "q": 9.0}


def test_labels(spark):
    flags = spark.createDataFrame([(True, True, False), (True, False, True), (False, False, True)], "a boolean, b boolean, c boolean")
    out = flags.select(structure.overlap_assessment({c: F.col(c) for c in "abc"}, ["b"]).alias("o")).collect()
    assert [r.o for r in out] == ["a,b", "", ""]


def test_large_cuts_are_never_broadcast(spark):
    """Packed ids are a file of a few kilobytes, by whose size they were sent to the driver."""
    large, small = graph.cut(spark.range(100_000).select("id", F.lit(1).alias("one"))), graph.cut(spark.range(9))
    joined = large.select("id").join(spark.range(10_000_000).filter("id % 3 = 0"), "id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    joined = small.join(spark.range(10_000_000), "id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
