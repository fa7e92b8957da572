"""Greedy modularity merges, whole connected components of a package's graph for each unit of work."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut, weak_components

#: Pairs of small components that are merged in one call.
UNIT = 10_000


def affinity(edges: Column, flow: Column) -> Column:
    """Weight of a tie between two responsibilities from their module edges and the symbols that flow."""
    return F.log1p(edges) + F.log1p(flow)


def modularity_groups(edges: DataFrame, by: str) -> DataFrame:
    """(by, id, group): greedy merges of the best modularity gain inside each `by` of edges (by, src, dst, weight).

    A group is named by its smallest node. A merge changes no gain outside its connected component and nodes of two
    components never merge, so components are merged apart, with the total weight of their `by`: a unit of work is whole
    components of about UNIT pairs, or one larger one. In it, pairs wait in a heap, and a merge touches the ties of the groups that it joins.
    """
    kind = edges.schema["src"].dataType.simpleString()
    outer = edges.schema[by].dataType.simpleString()
    pairs = edges.filter("src <> dst").groupBy(by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    pairs = cut(pairs)
    total = pairs.groupBy(by).agg(F.sum("weight").alias("_total"))
    ends = [F.struct(F.col(by).alias("of"), F.col(c).alias("id")).alias(c) for c in ("src", "dst")]
    ties = pairs.select(*ends)
    parts = weak_components(ties.select(F.explode(F.array("src", "dst")).alias("id")), ties)
    parts = parts.select(F.col("id.of").alias(by), F.col("id.id").alias("src"), F.col("component.id").alias("_part"))

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        total = float(part["_total"].iloc[0])
        ties: dict = defaultdict(dict)  # of each group, to every group that it is tied to
        degree: dict = defaultdict(float)
        for a, b, w in part[["src", "dst", "weight"]].sort_values(["src", "dst"]).itertuples(index=False):
            ties[a][b] = ties[b][a] = w
            degree[a] += w
            degree[b] += w
        groups = {n: {n} for n in ties}

        def entry(a, b) -> tuple:
            return -(ties[a][b] / total - degree[a] * degree[b] / (2 * total * total)), min(a, b), max(a, b)

        heap = [entry(a, b) for a in ties for b in ties[a] if a < b]
        heapq.heapify(heap)
        while total and heap:
            loss, a, b = heap[0]
            if a not in groups or b not in groups or entry(a, b)[0] != loss:  # overtaken: a newer entry is there, if any
                heapq.heappop(heap)
                continue
            if -loss <= 1e-12:
                break
            groups[a] |= groups.pop(b)
            degree[a] += degree.pop(b)
            for other, w in ties.pop(b).items():
                del ties[other][b]
                if other != a:
                    ties[a][other] = ties[other][a] = ties[a].get(other, 0.0) + w
            for other in ties[a]:
                heapq.heappush(heap, entry(a, other))
        return pd.DataFrame([(part[by].iloc[0], n, g) for g, members in groups.items() for n in members], columns=[by, "id", "group"])

    units = max(1, -(-pairs.count() // UNIT))
    rows = pairs.join(parts, [by, "src"]).join(total, by).withColumn("_unit", F.pmod(F.xxhash64("_part"), F.lit(units)))
    return rows.groupBy(by, "_unit").applyInPandas(merge, f"{by} {outer}, id {kind}, group {kind}")
