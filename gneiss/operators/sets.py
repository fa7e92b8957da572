"""Snapshot diffs, reconciliation, keyed merges, paging and multi-source merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change) of keys added, removed or changed in any value between two snapshots."""
    a = before.select(*keys, F.struct(*values).alias("_a"))
    b = after.select(*keys, F.struct(*values).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).filter("change is not null")


def reconcile(before: DataFrame, after: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, change, from_path) of an inventory: insert, update, delete, and moves of content that is unique on both sides."""
    a = before.select(F.col(path).alias("path"), F.col(digest).alias("_a"), F.lit(True).alias("_ina"))
    b = after.select(F.col(path).alias("path"), F.col(digest).alias("_b"), F.lit(True).alias("_inb"))
    both = a.join(b, "path", "full_outer")
    gone, fresh = both.filter("_inb is null"), both.filter("_ina is null")

    def unique(rows: DataFrame, c: str) -> DataFrame:
        return rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_d")).agg(F.count("*").alias("_n"), F.min("path").alias(f"_p{c}")).filter("_n = 1").drop("_n")

    moves = unique(gone, "_a").join(unique(fresh, "_b"), "_d").select(F.col("_p_b").alias("path"), F.lit("move").alias("change"), F.col("_p_a").alias("from_path"))
    none = F.lit(None).cast("string").alias("from_path")
    updated = both.filter(F.col("_ina").isNotNull() & F.col("_inb").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).select("path", F.lit("update").alias("change"), none)
    deleted = gone.select("path", F.lit("delete").alias("change"), none).join(moves.select(F.col("from_path").alias("path")), "path", "left_anti")
    inserted = fresh.select("path", F.lit("insert").alias("change"), none).join(moves.select("path"), "path", "left_anti")
    return moves.union(updated).union(deleted).union(inserted)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; pre-aggregated, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.max(F.struct(*order, *rest)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]])


def merged(base: DataFrame, changes: DataFrame, keys: list[str], deleted: str) -> DataFrame:
    """Base with each key replaced by its change, or removed where `deleted` holds."""
    kept = base.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes.filter(~F.col(deleted)).select(*base.columns))


def insert_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(rows.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def recovered(base: DataFrame, found: DataFrame, key: str, lost: str) -> DataFrame:
    """Recovered facts replace only those that were lost; new ones are added."""
    held = base.filter(~F.col(lost))
    fresh = found.join(held.select(key), key, "left_anti")
    return held.unionByName(fresh).unionByName(base.filter(F.col(lost)).join(fresh.select(key), key, "left_anti"))


def conflicts(sources: DataFrame, key: str, value: str) -> DataFrame:
    """Keys for which sources give different values, with how many."""
    return sources.groupBy(key).agg(F.countDistinct(value).alias("values"), F.count("*").alias("rows")).filter("values > 1")


def unambiguous(df: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """One row of each key whose rows agree on the fingerprint; keys whose rows differ are rejected whole."""
    return df.groupBy(key).agg(F.min(fingerprint).alias(fingerprint), F.max(fingerprint).alias("_h")).filter(F.col(fingerprint) == F.col("_h")).drop("_h")


def page(df: DataFrame, order: list, offset: int, limit: int = 50, most: int = 200) -> tuple[DataFrame, int | None, int]:
    """(rows, next offset or None, total)."""
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    limit, total = min(limit, most), df.count()
    return df.orderBy(*order).offset(offset).limit(limit), offset + limit if offset + limit < total else None, total


def page_after(df: DataFrame, order: list[str], cursor: tuple, limit: int = 50, newest: bool = False) -> DataFrame:
    """The next rows after a composite cursor."""
    at, mark = F.struct(*order), F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, cursor)])
    rows = df.filter(at < mark if newest else at > mark)
    return rows.orderBy(*[F.desc(c) if newest else F.asc(c) for c in order]).limit(limit)


def resolve(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, state, id): exact id, else a unique name or alias, else ambiguous or not-found. entities is (id, name, aliases)."""
    names = entities.select("id", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("n"))
    exact = entities.select(F.col("id").alias("query"), F.col("id").alias("_e")).distinct()
    named = names.select(F.lower("n").alias("_l"), "id").distinct().groupBy("_l").agg(F.count("*").alias("_c"), F.min("id").alias("_i"))
    out = queries.select("query").withColumn("_l", F.lower("query")).join(exact, "query", "left").join(named, "_l", "left")
    state = F.when(F.col("_e").isNotNull() | (F.col("_c") == 1), "resolved").when(F.col("_c") > 1, "ambiguous").otherwise("not-found")
    return out.select("query", state.alias("state"), F.when(F.col("_e").isNotNull(), F.col("_e")).when(F.col("_c") == 1, F.col("_i")).alias("id"))


def maximal_sequences(paths: DataFrame, path: str) -> DataFrame:
    """Array paths that lie in no longer path of the table; found through their own sub-sequences, not pairwise."""
    rows = paths.select(path).distinct()
    n = F.size(path)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n), lambda k: F.when((k < n) & (i + k - 1 <= n), F.slice(path, i, k)))))
    inner = rows.select(F.explode(spans).alias(path)).filter(F.col(path).isNotNull()).distinct()
    return rows.join(inner, path, "left_anti")


def running_total(df: DataFrame, by: list[str], order: list, value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))
