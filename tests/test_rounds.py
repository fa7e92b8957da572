"""Rounds of graph measures write what is still open, not the whole graph again."""

import random

import pytest

from gneiss.operators import blocks, graph
from gneiss.plans import internal as plans


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that a round writes."""
    rows, plain = [], graph.cut

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    monkeypatch.setattr(blocks, "cut", counted)
    return rows


def test_components_contract(spark, written):
    chain, n = 100, 1000
    nodes, edges = spark.range(n), spark.range(chain - 1).selectExpr("id as src", "id + 1 as dst")
    got = {r.id: r.component for r in graph.weak_components(nodes, edges).collect()}
    assert got == {i: 0 if i < chain else i for i in range(n)}
    assert sum(written) < 2 * n  # nodes without edges are written once


def test_layers_shrink(spark, written):
    parts = spark.range(300).selectExpr("id", "id as component", "1L as size")
    edges = spark.createDataFrame([(i + 1, i) for i in range(5)] + [(i, 0) for i in range(6, 300)], "src long, dst long")
    got = {r.id: r.layer for r in graph.layers(parts, edges).collect()}
    assert got == {i: i if i < 6 else 1 for i in range(300)}
    assert sum(written[1:]) < 30


def test_articulation_seeks_blocks_off_the_trees_only(spark, monkeypatch):
    rng = random.Random(0)
    tree = [(i, rng.randrange(i)) for i in range(1, 60)] + [(60, 61)]
    edges = [*tree, *((rng.randrange(60), rng.randrange(60)) for _ in range(4)), (3, 3)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    want = {r.id for r in blocks.cut_nodes(blocks.blocks(spark.range(62), frame)).collect()}
    seen, plain = [], blocks.blocks
    monkeypatch.setattr(blocks, "blocks", lambda nodes, e: seen.append(nodes.count()) or plain(nodes, e))
    assert {r.id for r in blocks.articulation(frame).collect()} == want
    assert seen[0] < 45
    bare = spark.createDataFrame(tree, "src long, dst long")
    several = {r.id for r in blocks.both_ways(bare).groupBy("src").count().filter("count > 1").selectExpr("src as id").collect()}
    assert {r.id for r in blocks.articulation(bare).collect()} == several and seen[1] == 0


def test_lone_lines_are_not_joined(spark, tmp_path, monkeypatch):
    rows = [(o, n, 100 * o + n, 0.1, 0.0, "R") for o in range(50) for n in range(4)]
    rows += [(90, 1, 5, 0.0, 0.1, "N"), (90, 2, 45, 0.0, 0.1, "N"), (90, 2, 85, 0.1, 0.1, "R"), (90, 4, 5, 0.1, 0.1, "R"), (None, 1, 5, 0.1, 0.1, "R"), (None, 2, 45, 0.1, 0.1, "R")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_tax double, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    joined, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: joined.append(df.count()) or plain(df))
    got = sorted(tuple(r) for r in plans._steps(spark, str(tmp_path)).collect())
    assert got == [(45, 5, True, False, 1), (85, 5, True, False, 1)]
    assert joined == [4]


def test_regions_read_the_lines_once(spark, monkeypatch):
    read, plain = [], plans.table
    monkeypatch.setattr(plans, "table", lambda s, d, name: read.append(name) or plain(s, d, name))
    stub = spark.createDataFrame([], "package string, module string, symbol string, status string, region string, reason string")
    for name in ("topology", "localized_symbols", "responsibilities"):
        monkeypatch.setattr(plans.internal, name, lambda *_: stub)
    plans.responsibility_regions(spark, "/root/testdata/sf0.001")
    assert read.count("lineitem") == 1
