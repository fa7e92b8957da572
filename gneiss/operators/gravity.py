"""Gravity of nodes in a dependency graph, complexity of files, and what changes often where it weighs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, with_strict_rank
from ..policy import DEFAULT, Policy
from . import graph
from .rules import signals


def gravity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each node: cycle size, depth on either side, direct and transitive neighbours, reach.

    downstream is the longest path of components that depend on the node's, upstream that of those
    it depends on; cycle is 0 outside a cycle; reach is the share of all other nodes (0 without any).
    """
    reach = graph.closure(edges)
    parts = graph.cut(graph.strong_components(nodes, edges))
    up = graph.layers(parts, edges).select("id", F.col("layer").alias("upstream"))
    down = graph.layers(parts, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("id", F.col("layer").alias("downstream"))
    counts = graph.reach_counts(nodes, reach)
    n = nodes.agg((F.count("*") - 1).alias("_n"))  # one row
    out = graph.degrees(nodes, edges).drop("role").join(counts.drop("reach_share"), "id").join(parts, "id").join(up, "id").join(down, "id").join(F.broadcast(n))
    return out.select(
        "id", F.when(F.col("size") > 1, F.col("size")).otherwise(0).alias("cycle"), "downstream", "upstream", "fan_in", "fan_out", "dependencies", "dependents",
        ratio(F.col("dependencies"), F.col("_n")).alias("dependency_reach"), ratio(F.col("dependents"), F.col("_n")).alias("dependent_reach"),
    )


def grouped_layers(layers: DataFrame) -> DataFrame:
    """(layer, nodes, members) of (id, layer): each layer with the number of its nodes and the least and last of their ids."""
    return layers.groupBy("layer").agg(F.count("*").alias("nodes"), F.min("id").alias("first"), F.max("id").alias("last"))


def file_complexity(functions: DataFrame) -> DataFrame:
    """Functions (file, control, expression, nesting, statements) summed up by file, with the largest of each."""
    return functions.groupBy("file").agg(
        F.count("*").alias("functions"),
        *[F.sum(c).alias(f"{c}_total") for c in ("control", "expression", "statements")],
        *[F.max(c).alias(f"{c}_max") for c in ("control", "expression", "nesting", "statements")],
    )


def hotspots(churn: DataFrame, complexity: DataFrame, weights: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Files that change often and are complex, with their signals.

    churn is (file, kind, commits, commit_rank), complexity that of file_complexity(), weights
    gravity rows by file (id). A file without functions has none of their numbers. complexity_rank
    is the strict rank of the largest number of control decisions among all files of eligible kinds.
    """
    measures = ("functions", "control_total", "control_max", "nesting_max")
    rows = churn.filter(F.col("kind").isin(*policy.hotspot_kinds)).join(complexity.select("file", *measures), "file", "left").na.fill(0, list(measures))
    rows = with_strict_rank(rows, "control_max", [], "complexity_rank")
    branchy, deep = F.col("control_max") >= policy.branch_heavy, F.col("nesting_max") >= policy.deep_nesting
    dense = (F.col("control_total") >= policy.dense_decisions) & (F.col("functions") >= policy.dense_functions)
    rows = rows.filter((F.col("commit_rank") >= policy.hotspot_percentile) & (branchy | deep | dense))
    rows = rows.join(weights.select(F.col("id").alias("file"), "fan_in", "fan_out"), "file", "left")
    central = F.coalesce((F.col("fan_in") >= policy.central_fan_in) | (F.col("fan_out") >= policy.central_fan_out), F.lit(False))
    named = signals({"frequent-change": F.lit(True), "branch-heavy": branchy, "deep-control-flow": deep, "complexity-dense": dense, "architecturally-central": central})
    return rows.select("file", "commits", "commit_rank", "complexity_rank", "fan_in", "fan_out", named.alias("signals"))


def structural_hubs(churn: DataFrame, weights: DataFrame, functions: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Source files near the top of churn on which many others depend, with their number of functions."""
    rows = churn.filter(F.col("kind").isin(*policy.hotspot_kinds) & (F.col("commit_rank") >= policy.structural_hub_percentile))
    hubs = rows.join(weights.filter(F.col("fan_in") >= policy.structural_hub_fan_in).select(F.col("id").alias("file"), "fan_in", "fan_out"), "file")
    counts = functions.groupBy("file").agg(F.count("*").alias("functions"))
    return hubs.join(counts, "file", "left").na.fill(0, ["functions"]).select("file", "commits", "commit_rank", "fan_in", "fan_out", "functions")


def frequent_change(churn: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Rows (package, file, kind, commits, lines_changed, commit_rank) of eligible kinds at or above the percentile."""
    return churn.filter(F.col("kind").isin(*policy.hotspot_kinds) & (F.col("commit_rank") >= policy.hotspot_percentile)).drop("kind")
