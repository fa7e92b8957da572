"""Commits that count in history analyses, how far each reaches, and what they say together.

changes is (commit, ts, path, additions, deletions): one row for each path a commit touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import file_kind
from ..functions.stats import distribution, ratio
from ..policy import DEFAULT, Policy
from .deal import deal

KINDS = ("config", "other", "source", "story", "test")


def excluded(path: Column, policy: Policy = DEFAULT) -> Column:
    """True for paths with a generated or vendored folder among their segments."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, policy.excluded_folders)))


def eligible_changes(changes: DataFrame, tracked: DataFrame, since: Column | None = None, aliases: DataFrame | None = None, policy: Policy = DEFAULT, number: int | None = None) -> DataFrame:
    """(commit, ts, path, kind, additions, deletions) of tracked, eligible paths since a time, once for each commit and path.

    tracked is (path); aliases (old, final) of renamed paths. Lines are summed over the rows of a
    path; a sum is null if all of them are. With the number of changes, rows are dealt by path (see deal()).
    """
    rows = changes if since is None else changes.filter(F.col("ts") >= since)
    if aliases is not None:
        names = aliases.select(F.col("old").alias("path"), "final").distinct()
        rows = rows.join(names, "path", "left").withColumn("path", F.coalesce("final", "path"))
    rows = rows.withColumn("kind", file_kind(F.col("path"))).filter(F.col("kind").isin(*policy.eligible_kinds) & ~excluded(F.col("path"), policy))
    rows = deal(rows, number, "path").join(deal(tracked.select("path").distinct(), number, "path"), "path", "left_semi")
    return rows.groupBy("commit", "path").agg(F.min("ts").alias("ts"), F.first("kind").alias("kind"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def eligible_commits(rows: DataFrame, owners: DataFrame, policy: Policy = DEFAULT, number: int | None = None) -> DataFrame:
    """One row for each commit of eligible_changes(): files by kind, owners touched, composition and whether it is oversized.

    owners is (path, owner); paths without an owner count as files only. A commit is oversized with
    too many code files, or as a configuration sweep over many packages. Owners are few for each
    commit that is not oversized; their sorted set is kept as text. With the number of rows, they are dealt by commit (see deal()).
    """
    single = deal(rows.join(deal(owners.select("path", "owner"), number, "path"), "path", "left"), number, "commit")
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS]
    out = single.groupBy("commit").agg(
        F.min("ts").alias("ts"), F.count("*").alias("files"), *counts, F.array_join(F.array_sort(F.collect_set("owner")), "|").alias("packages"), F.countDistinct("owner").alias("n_packages"),
        F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
    )
    share = F.col("config") / F.col("files")
    composition = F.when(share >= policy.config_dominant_share, "config-dominant").when(share <= policy.source_dominant_config_share, "source-dominant").otherwise("mixed")
    out = out.withColumn("composition", composition)
    code = F.col("files") - F.col("config") - F.col("other")
    sweep = (F.col("composition") == "config-dominant") & (F.col("n_packages") >= policy.config_sweep_packages)
    return out.withColumn("oversized", (code > policy.max_code_files) | sweep)


def change_radius(rows: DataFrame, commits: DataFrame, owners: DataFrame, owner_edges: DataFrame, target: str, number: int | None = None) -> DataFrame:
    """How far each commit that is not oversized and touches the target owner reaches.

    owner_edges is (from, to), each dependency between two owners once; a boundary is crossed where
    a commit touches both of its ends. lines_changed is null only where additions and deletions are.
    """
    owned = deal(rows.join(deal(owners.select("path", "owner"), number, "path"), "path"), number, "commit")
    mine = owned.filter(F.col("owner") == target).groupBy("commit").agg(F.count("*").alias("target_files"))
    kept = commits.filter("not oversized").join(mine, "commit")
    touched = owned.join(kept.select("commit"), "commit", "left_semi").select("commit", "owner").distinct()
    left, right = touched.withColumnRenamed("owner", "from"), touched.withColumnRenamed("owner", "to")
    crossed = left.join(owner_edges.select("from", "to").distinct(), "from").join(right, ["commit", "to"]).groupBy("commit").agg(F.count("*").alias("boundaries"))
    lines = F.when(F.col("additions").isNotNull() | F.col("deletions").isNotNull(), F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0)))
    out = kept.join(crossed, "commit", "left").withColumn("boundaries", F.coalesce("boundaries", F.lit(0))).withColumn("lines_changed", lines)
    return out.withColumn("target_share", ratio(F.col("target_files"), F.col("files"))).drop("oversized")


def radius_totals(reach: DataFrame) -> DataFrame:
    """One row over change_radius(): rates of commits across packages and boundaries, and spreads."""
    out = reach.agg(
        F.count("*").alias("commits"),
        F.coalesce(F.avg((F.col("n_packages") > 1).cast("int")), F.lit(0.0)).alias("cross_package_rate"),
        F.coalesce(F.avg((F.col("boundaries") > 0).cast("int")), F.lit(0.0)).alias("boundary_rate"),
        *[c.cast("long").alias(f"{name}_{n}") for name in ("files", "n_packages", "boundaries", "source") for c, n in zip(distribution(name), ("max", "p50", "p90", "p95"))],
    )
    return out


def combinations(reach: DataFrame, k: int) -> DataFrame:
    """The k most frequent sets of several packages, smaller sets and then names first among equals."""
    counts = reach.filter("n_packages > 1").groupBy("packages", "n_packages").agg(F.count("*").alias("commits"))
    return counts.orderBy(F.desc("commits"), "n_packages", "packages").limit(k)
