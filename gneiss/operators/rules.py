"""Classifiers of rows by ordered or multi-label rules, Pareto fronts, covers and violations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalar import ancestors, covers
from ..functions.stats import clamp01, running_before
from .graph import cut


def signals(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order, as one string (empty for none)."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])), ",")


def first_of(rules: dict[str, Column], otherwise: str) -> Column:
    """Name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, condition in reversed(rules.items()):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


FRONT_TILE = 4096


def _beaten(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows of points some row of `by` matches everywhere and beats somewhere; less is better."""
    out = np.zeros(len(points), bool)
    for at in range(0, len(points), 256):
        part = points[at : at + 256, None, :]
        out[at : at + 256] = ((by[None] <= part).all(2) & (by[None] < part).any(2)).any(1)
    return out


def pareto(df: DataFrame, id_col: str, smaller: list[str], larger: list[str]) -> DataFrame:
    """Rows that no other row matches everywhere and beats somewhere; smaller and larger name what is better.

    Equal rows are one candidate, so a front is compared by distinct values. Each task keeps the
    front of its own points first; what is left is cut in tiles, and pairs of tiles are compared by
    key, so no side is broadcast and no task holds more than two tiles. Rows with a null are left out.
    """
    values = smaller + larger
    points = df.select(*values).distinct().dropna()
    better = points.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(smaller)], *[(-F.col(c).cast("double")).alias(f"_{len(smaller) + i}") for i, c in enumerate(larger)], *values)
    names = [f"_{i}" for i in range(len(values))]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front = None
        for batch in batches:
            for at in range(0, len(batch), FRONT_TILE):
                part = batch.iloc[at : at + FRONT_TILE]
                both = part if front is None else pd.concat([front, part])
                x = both[names].to_numpy()
                both = both[~_beaten(x, x)]
                if len(both) > 4 * FRONT_TILE:  # a large front goes on in parts
                    yield both
                    both = None
                front = both
        if front is not None:
            yield front

    kept = cut(better.mapInPandas(local, better.schema))
    tiles = max(1, -(-kept.count() // FRONT_TILE))
    tiled = kept.withColumn("_t", F.pmod(F.xxhash64(*names), F.lit(tiles)).cast("int"))
    dealt = tiled.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = dealt.select(F.least("_t", "_o").alias("_p"), F.greatest("_t", "_o").alias("_q"), "_t", *names, *values)

    def losers(part: pd.DataFrame) -> pd.DataFrame:
        x = part[names].to_numpy()
        return part.loc[_beaten(x, x), values]

    beaten = dealt.groupBy("_p", "_q").applyInPandas(losers, df.select(*values).schema).distinct()
    front = kept.select(*values).join(beaten, values, "left_anti")
    return df.join(front, values, "left_semi").select(id_col, *values)


def reviewed(items: DataFrame, measures: list[str], invalid: str, order: str) -> DataFrame:
    """(subject, id, state) of alternatives (subject, id, ...) of each subject: invalid, indistinguishable, dominated or viable.

    Less is better in every measure; a null is not measured and makes two alternatives incomparable.
    Invalid ones judge nobody. One that equals an earlier one (by `order`) is indistinguishable from
    it; one that another is never worse than and somewhere better than is dominated. (subject, id) is a key.

    Alternatives with the same values share one verdict, so values are compared, never pairs of rows: two numbers by a
    running minimum, other measures with the least last value for each of the others.
    """
    at = ["subject", *measures]
    valid = items.filter(~F.col(invalid)).dropna(subset=["id", *at])
    places = valid.groupBy(*at).agg(F.min(order).alias("_first"))
    rest, last = measures[:-1], measures[-1]
    judges = places.groupBy("subject", *rest).agg(F.min(last).alias("_least"))
    if len(rest) == 1 and all(isinstance(items.schema[c].dataType, NumericType) for c in measures):
        below = running_before(judges, ["subject"], rest[0], "_least", "_below", "min").select("subject", *rest, "_least", "_below")
        judged = places.join(below, ["subject", *rest]).withColumn("_beaten", F.coalesce(F.col("_below") <= F.col(last), F.lit(False)) | (F.col("_least") < F.col(last)))
    else:
        never_worse, better = F.col("_least") <= F.col(last), F.col("_least") < F.col(last)
        for c in rest:
            never_worse, better = never_worse & (F.col(f"_{c}") <= F.col(c)), better | (F.col(f"_{c}") < F.col(c))
        judges = judges.select("subject", "_least", *[F.col(c).alias(f"_{c}") for c in rest])
        judged = places.join(judges, "subject").groupBy(*at, "_first").agg(F.max(never_worse & better).alias("_beaten"))
    out = items.join(judged.select(*at, "_first", "_beaten"), at, "left")
    twin = F.col("_first") < F.col(order)
    state = F.when(F.col(invalid), "invalid").when(F.col(invalid).isNull() | F.col("id").isNull(), "viable").when(twin, "indistinguishable").when(F.col("_beaten"), "dominated").otherwise("viable")
    return out.select("subject", "id", state.alias("state"))


def skyline(df: DataFrame, id_col: str, smaller: str, larger: str) -> DataFrame:
    """pareto() of two numbers by one sort: a row stays if no row that is smaller or equal has more."""
    best = df.groupBy(smaller).agg(F.max(larger).alias("_m"))
    front = running_before(best, [], smaller, "_m", "_b", "max").filter(F.col("_b").isNull() | (F.col("_m") > F.col("_b"))).select(smaller, F.col("_m").alias(larger))
    return df.join(front, [smaller, larger], "left_semi").select(id_col, smaller, larger)


def covered_by(places: DataFrame, place: str, facets: DataFrame, facet: str) -> DataFrame:
    """(place, facet) for every facet that covers a place: an equi-join on the place's own prefixes."""
    rows = places.withColumn("_x", F.explode(F.array_append(ancestors(F.col(place)), F.col(place))))
    return rows.join(facets.withColumn("_x", F.col(facet)), "_x").filter(covers(F.col(facet), F.col(place))).drop("_x")


def violations(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings (id, place) under the facet of a required rule (rule, facet, required)."""
    required = rules.filter("required").select("rule", "facet")
    return covered_by(findings.select("id", "place"), "place", required, "facet").select("rule", "facet", "id", "place").distinct()


def relabelled(df: DataFrame, home: str, away: str) -> DataFrame:
    """shares-domain where every away place has a domain in common with home (arrays), else crosses-domain."""
    shared = F.size(away) > 0
    return df.withColumn("label", F.when(shared & F.forall(away, lambda d: F.array_contains(F.col(home), d)), "shares-domain").otherwise("crosses-domain"))


def fold_score(weights: dict[str, float]) -> Column:
    """Weighted sum of columns kept within 0 and 1."""
    return clamp01(sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0)))
