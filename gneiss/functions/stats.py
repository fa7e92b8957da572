"""Ratios, ranks, quantiles and distributions with the exact conventions of the analytics operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where bottom is 0 or null."""
    return F.when(F.coalesce(bottom, F.lit(0)) == 0, F.lit(0.0)).otherwise(top / F.nullif(bottom.cast("double"), F.lit(0.0)))


def ratio_or_null(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is 0 or null."""
    return top / F.nullif(bottom.cast("double"), F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def jaccard_of_counts(both: Column, left: Column, right: Column) -> Column:
    """Shared over united counts, 0 for an empty union."""
    return ratio(both, left + right - both)


BUCKETS = 128


def running_before(df: DataFrame, by: list[str], value: str, measure: str, name: str, how: str = "sum") -> DataFrame:
    """Sum, maximum or minimum of `measure` over the group's rows with a smaller value; value is numeric and distinct in its group.

    A group may be the whole table, so it is not given to one task: values fall in BUCKETS ranges of
    about as many rows each, cut at quantiles, ranges are totalled, and each range runs on its own.
    """
    total = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    at = F.col(value).cast("double")
    ends = df.groupBy(*by).agg(F.percentile_approx(at, F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), F.lit(1000)).alias("_cuts"))
    bucket = F.size(F.filter("_cuts", lambda c: c < at))

    def back(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
        """Joined on keys that may be null."""
        named = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        joined = rows.join(named, same) if keys else rows.join(F.broadcast(named))  # without keys it is one row
        return joined.drop(*[f"_k{i}" for i in range(len(keys))])

    rows = back(df, ends, by).withColumn("_bucket", bucket).drop("_cuts")
    sums = rows.groupBy(*by, "_bucket").agg(total(measure).alias("_t"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows of a group at most
    sums = sums.withColumn("_before", total("_t").over(earlier)).drop("_t")
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = back(rows.withColumn("_inside", total(measure).over(inside)), sums, [*by, "_bucket"])
    both = F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0)) if how == "sum" else {"max": F.greatest, "min": F.least}[how]("_before", "_inside")
    return rows.withColumn(name, both).drop("_bucket", "_before", "_inside")


def with_strict_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Share of the group's rows with a strictly smaller number; neither percent_rank nor cume_dist. Nulls rank 0.

    Counts of each distinct value are ranked, not the rows.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    totals = df.groupBy(*by).agg(F.count("*").alias("_all"))
    known = counts.filter(F.col(value).isNotNull())
    ranks = running_before(known, by, value, "_n", "_below").select(*[F.col(c).alias(f"_{c}") for c in by], F.col(value).alias("_v"), "_below")
    totals = totals.select(*[F.col(c).alias(f"_t{c}") for c in by], "_all")
    same, group = F.col(value) == F.col("_v"), F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        group &= F.col(c).eqNullSafe(F.col(f"_t{c}"))
    out = df.join(ranks, same, "left")
    out = out.join(totals, group) if by else out.join(F.broadcast(totals))  # one row
    return out.withColumn(name, F.coalesce("_below", F.lit(0)) / F.col("_all")).drop("_v", "_below", "_all", *[f"_{c}" for c in by], *[f"_t{c}" for c in by])


def nearest_rank(value: str, p: float) -> Column:
    """The value at index ceil(p n) - 1 of the sorted group, 0 for none."""
    return F.coalesce(F.expr(f"percentile_disc({p}) within group (order by `{value}`)"), F.lit(0))


def distribution(value: str, shape: str = "tail") -> list[Column]:
    """Aggregates: "tail" gives max, p50, p90 and p95; "spread" gives min, median, p90 and max."""
    if shape == "tail":
        return [F.coalesce(F.max(value), F.lit(0)).alias("max"), *[nearest_rank(value, p).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.95)]]
    if shape == "spread":
        ends = F.coalesce(F.min(value), F.lit(0)).alias("min"), F.coalesce(F.max(value), F.lit(0)).alias("max")
        return [ends[0], nearest_rank(value, 0.5).alias("median"), nearest_rank(value, 0.9).alias("p90"), ends[1]]
    raise ValueError(f"unknown shape {shape}")


def aggregate(value: str) -> list[Column]:
    """Total, average (0 for none) and the tail distribution."""
    return [F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.coalesce(F.avg(value), F.lit(0.0)).alias("average"), *distribution(value)]


def all_or_nothing_sum(x: Column) -> Column:
    """Sum, or null if any member of the group has none."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))
