"""Joining rows back to the aggregates of their groups when a few groups hold many of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_GROUPS = 10_000
LEAST = 1000  # rows below which no group is large


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, least: int | None = None) -> DataFrame:
    """rows ⋈ groups on keys, where `size` is the number of rows of each group and total that of all.

    At most HOT_GROUPS groups can hold total / HOT_GROUPS rows or more: those are broadcast, and
    their rows never meet in one task. All other groups are small and are joined by a shuffle.
    `least` states another size from which a group counts as large.
    """
    least = least or max(LEAST, total // HOT_GROUPS)
    hot = F.broadcast(groups.filter(F.col(size) >= least))
    cold = groups.filter(F.col(size) < least)
    rest = rows.join(F.broadcast(groups.filter(F.col(size) >= least).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold.hint("merge"), keys))


def join_salted(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, least: int) -> DataFrame:
    """join_groups() in one join, for groups of a few narrow columns: rows of a group of `least` rows or more
    are dealt over one task for each `least` of them, and the group is repeated for each of these.

    Only the keys of large groups are broadcast; both sides are read and shuffled once.
    """
    parts = F.ceil(F.col(size) / least).cast("int")
    large = groups.filter(F.col(size) >= least).select(*keys, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(large), keys, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_parts"))).cast("int")).drop("_parts")
    salts = F.sequence(F.lit(0), F.when(F.col(size) >= least, parts - 1).otherwise(0))
    return dealt.join(groups.withColumn("_salt", F.explode(salts)).hint("merge"), [*keys, "_salt"]).drop("_salt")
