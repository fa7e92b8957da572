"""Grouped measures: shares, traffic, size pivots, folder and step-tree rollups, ownership, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ancestors
from ..functions.stats import ratio, running_before
from .graph import cut


def concentration(df: DataFrame, key: str) -> DataFrame:
    """Rows of each key and their share of all."""
    counts = df.groupBy(key).agg(F.count("*").alias("edges"))
    total = df.agg(F.count("*").alias("_t"))  # one row
    return counts.join(F.broadcast(total)).select(key, "edges", ratio(F.col("edges"), F.col("_t")).alias("share"))


def distributions(df: DataFrame, by: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Total, average, max and min of a numeric value in each group, and its nearest-rank quantiles by name: as stats.aggregate(), 0 for none.

    A group may be the whole table. Its distinct values are counted, and the counts run up in ranges of their own, so
    no task holds the values of a group.
    """
    zero = F.lit(0)
    whole = df.groupBy(*by).agg(F.coalesce(F.sum(value), zero).alias("total"), F.coalesce(F.avg(value), F.lit(0.0)).alias("average"), F.coalesce(F.max(value), zero).alias("max"), F.coalesce(F.min(value), zero).alias("min"), F.count(value).alias("_all"))
    whole = cut(whole.select("*", *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).drop(*by))
    counts = cut(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")))
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    placed = running_before(counts, by, value, "_n", "_below").join(whole.select("_all", *[f"_g{i}" for i in range(len(by))]), same)
    upto = F.col("_below") + F.col("_n")
    found = placed.groupBy(*by).agg(*[F.min(F.when(upto >= F.ceil(F.lit(p) * F.col("_all")), F.col(value))).alias(name) for name, p in ranks.items()])
    out = whole.join(found, same, "left")
    return out.select(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(by)], "total", "average", "max", *[F.coalesce(n, zero).alias(n) for n in ranks], "min")


def traffic(edges: DataFrame, consumer_owner: str, supplier_owner: str, consumer: str, supplier: str) -> DataFrame:
    """Distinct consumers and suppliers of each ordered pair of different owners."""
    e = edges.filter(F.col(consumer_owner) != F.col(supplier_owner))
    return e.groupBy(consumer_owner, supplier_owner).agg(F.countDistinct(consumer).alias("consumers"), F.countDistinct(supplier).alias("suppliers"), F.count("*").alias("links"))


def consumers(refs: DataFrame, supplier: str, consumer: str, symbol: str, flag: Column) -> DataFrame:
    """References, symbols, namespace bits, and both shares of each consumer of a supplier."""
    out = refs.groupBy(supplier, consumer).agg(F.count("*").alias("references"), F.countDistinct(symbol).alias("symbols"), F.bit_or(flag).alias("namespace"))
    surface = refs.groupBy(supplier).agg(F.countDistinct(symbol).alias("surface"), F.count("*").alias("_all"))
    out = out.join(surface, supplier)
    return out.select(supplier, consumer, "references", "symbols", "namespace", ratio(F.col("references"), F.col("_all")).alias("reference_share"), ratio(F.col("symbols"), F.col("surface")).alias("surface_share"))


def primary_consumer(rows: DataFrame, supplier: str, consumer: str) -> DataFrame:
    """The consumer of each supplier with most references, then most symbols, then the smallest name."""
    best = F.min(F.struct((-F.col("references")).alias("r"), (-F.col("symbols")).alias("s"), F.col(consumer).alias("c")))
    return rows.groupBy(supplier).agg(best.alias("b")).select(supplier, F.col("b.c").alias("primary_consumer"), (-F.col("b.r")).alias("references"))


def size_pivot(df: DataFrame, owners: DataFrame, owner: str, kind: str, kinds: list[str]) -> DataFrame:
    """Rows of each kind for every owner, zeros filled in, and their total."""
    counts = df.groupBy(owner).pivot(kind, kinds).count()
    out = owners.select(owner).join(counts, owner, "left").na.fill(0, kinds)
    total = F.lit(0)
    for k in kinds:
        total = total + F.col(f"`{k}`")
    return out.select(owner, *[F.col(f"`{k}`").alias(k) for k in kinds], total.alias("total"))


def nesting(paths: DataFrame, path: str) -> DataFrame:
    """Files directly in and anywhere below every folder."""
    rows = paths.select(F.col(path).alias("p"), ancestors(F.col(path)).alias("a")).select(F.posexplode("a").alias("i", "folder"), (F.size("a") - 1).alias("last"))
    return rows.groupBy("folder").agg(F.count(F.when(F.col("i") == F.col("last"), 1)).alias("direct"), F.count("*").alias("descendants"))


def step_tree(facts: DataFrame, run: str, path: str, value: str) -> DataFrame:
    """Direct and inclusive sums of every prefix of an array path."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, 1, n))
    rows = facts.filter(F.size(path) > 0).select(run, F.explode(prefixes).alias("step"), F.col(path).alias("_p"), F.col(value).alias("_v"))
    return rows.groupBy(run, F.array_join("step", "/").alias("step")).agg(F.sum(F.when(F.size("step") == F.size("_p"), F.col("_v")).otherwise(0)).alias("direct"), F.sum("_v").alias("inclusive"))


def placement(df: DataFrame, levels: list[str], home: str, consumer: str, dominant: float) -> DataFrame:
    """Home and away consumers of every level of a hierarchy, and whether one consumer dominates."""
    out = None
    for i, level in enumerate(levels):
        per = df.groupBy(F.lit(level).alias("level"), F.col(level).cast("string").alias("id"), F.col(consumer).alias("_c")).agg(F.count("*").alias("_n"), F.max((F.col(home) == F.col(consumer)).cast("int")).alias("_h"))
        one = per.groupBy("level", "id").agg(F.count("*").alias("consumers"), F.sum("_h").alias("home"), F.sum("_n").alias("uses"), F.max("_n").alias("_top"))
        out = one if out is None else out.union(one)
    share = ratio(F.col("_top"), F.col("uses"))
    return out.select("level", "id", "consumers", "home", (F.col("consumers") - F.col("home")).alias("away"), "uses", share.alias("top_share"), (share >= dominant).alias("dominant"))


def leaders(df: DataFrame, subject: str, dimension: str, owner: str, value: str, seed: str) -> DataFrame:
    """Owner with the largest positive value of each subject and dimension; ties prefer the seed, then the smallest name."""
    order = F.struct((-F.col(value)).alias("v"), (F.col(owner) != F.col(seed)).alias("s"), F.col(owner).alias("o"))
    rows = df.filter(F.col(value) > 0).groupBy(subject, dimension).agg(F.min(order).alias("b"), F.sum(value).alias("_t"))
    return rows.select(subject, dimension, F.col("b.o").alias("leader"), ratio(-F.col("b.v"), F.col("_t")).alias("share"))


def weighted_share(shares: dict[str, float]) -> Column:
    """Weighted mean of the columns that are not null, weights scaled anew over those."""
    top = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in shares.items()), F.lit(0.0))
    bottom = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in shares.items()), F.lit(0.0))
    return ratio(top, bottom)


def rank_metrics(df: DataFrame, id_col: str, metrics: list[str], k: int) -> DataFrame:
    """For each metric the k largest positive values, ties by id, with the number of all positive ones."""
    long = df.select(F.col(id_col).alias("id"), *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["id"], metrics, "metric", "value").filter("value > 0")
    totals = long.groupBy("metric").agg(F.count("*").alias("total"))
    w = Window.partitionBy("metric").orderBy(F.desc("value"), "id")
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).join(F.broadcast(totals), "metric")  # a row for each metric


def matrix(df: DataFrame, row: str, column: str, entity: str) -> DataFrame:
    """Sparse cells with their count of distinct entities."""
    return df.groupBy(F.col(row).alias("row"), F.col(column).alias("column")).agg(F.countDistinct(entity).alias("value"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """Rows of each value; those without one under "null"."""
    return df.groupBy(F.coalesce(F.col(value).cast("string"), F.lit("null")).alias("value")).agg(F.count("*").alias("n"))


def observation_density(df: DataFrame, entity: str, source: str) -> DataFrame:
    """How many entities 1, 2, and 3 or more sources saw."""
    seen = df.groupBy(entity).agg(F.countDistinct(source).alias("s"))
    bucket = F.when(F.col("s") >= 3, "3+").otherwise(F.col("s").cast("string"))
    return seen.groupBy(bucket.alias("sources")).agg(F.count("*").alias("entities"))


#: The statuses that count as they are; runs that are paused or ask for attention count as waiting.
RUN_COUNTS = ("cancelled", "complete", "failed", "queued", "running")
PAUSED = ("suspended", "paused")


def operating_stats(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs (status, attention, created_at, started_at, ended_at in ms) by keys: the number of each kind, success rate, median times.

    A run that asks for attention or is paused counts as waiting, whatever its status; statuses not
    known count in the total only. The success rate is complete / (complete + failed), null without either. The median run time is over
    runs that started and ended, the median time in the queue (0 at least) over those that started.
    """
    waits = F.coalesce(F.col("attention"), F.lit(False)) | F.col("status").isin(*PAUSED)
    counts = {name: F.count(F.when(~waits & (F.col("status") == name), 1)) for name in RUN_COUNTS} | {"waiting": F.count(F.when(waits, 1))}
    out = runs.groupBy(*by).agg(
        *[c.alias(name) for name, c in counts.items()],
        F.count("*").alias("total"),
        F.median(F.col("ended_at") - F.col("started_at")).alias("median_run_ms"),
        F.median(F.when(F.col("started_at").isNotNull(), F.greatest(F.col("started_at") - F.col("created_at"), F.lit(0)))).alias("median_queue_ms"),
    )
    return out.withColumn("success_rate", ratio(F.col("complete"), F.col("complete") + F.col("failed")))
