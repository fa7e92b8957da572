"""Usage: sums, tiered prices, limits, budgets, catalogue lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import all_or_nothing_sum


def usage_by(df: DataFrame, keys: list[str], quantities: list[str], charge: str) -> DataFrame:
    """Sums of quantities by the keys; the charge is null if any member has none."""
    return df.groupBy(*keys).agg(F.count("*").alias("items"), *[F.coalesce(F.sum(q), F.lit(0)).alias(q) for q in quantities], all_or_nothing_sum(F.col(charge)).alias("charge"))


def usage_totals(df: DataFrame, tokens: str, cost_kind: str, amount: str, currency: str) -> DataFrame:
    """By currency: turns, tokens, those without tokens or price, and money reported and estimated."""
    kind = F.col(cost_kind)
    return df.groupBy(F.coalesce(F.col(currency), F.lit("none")).alias("currency")).agg(
        F.count("*").alias("turns"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"),
        F.count(F.when(F.col(tokens).isNull(), 1)).alias("untokened"),
        F.count(F.when(kind == "unknown", 1)).alias("unpriced"),
        F.coalesce(F.sum(F.when(kind == "reported", F.col(amount))), F.lit(0.0)).alias("reported"),
        F.coalesce(F.sum(F.when(kind == "estimated", F.col(amount))), F.lit(0.0)).alias("estimated"),
    )


def with_known_ids(rollup: DataFrame, known: DataFrame, key: str, zero: list[str]) -> DataFrame:
    """The rollup with a zero row for every known id it lacks."""
    return known.select(key).distinct().join(rollup, key, "full_outer").na.fill(0, zero)


def tier_rate(tiers: Column, tokens: Column, flat: Column) -> Column:
    """Rate of the first bracket (min_tokens, max_tokens or null, rate) that holds the tokens, else the flat rate."""
    held = F.filter(tiers, lambda t: (tokens >= t.min_tokens) & (t.max_tokens.isNull() | (tokens < t.max_tokens)))
    return F.coalesce(F.get(held, F.lit(0)).rate, flat)


def token_cost(input_: Column, cached: Column, written: Column, output: Column, reasoning: Column, rates: dict[str, Column]) -> Column:
    """Price per million: input without cached and written tokens, reasoning at the output rate."""

    def n(x: Column) -> Column:
        return F.coalesce(x, F.lit(0))

    plain = F.greatest(n(input_) - n(cached) - n(written), F.lit(0))
    total = plain * rates["input"] + n(cached) * rates["cached"] + n(written) * rates["written"] + (n(output) + n(reasoning)) * rates["output"]
    return total / 1_000_000


def tier_brackets(thresholds: DataFrame, key: str, size: str, rate: str) -> DataFrame:
    """Brackets [min_tokens, max_tokens) of each key from its thresholds; the last is open."""
    w = Window.partitionBy(key).orderBy(size)
    return thresholds.select(key, F.col(size).alias("min_tokens"), F.lead(size).over(w).alias("max_tokens"), F.col(rate).alias("rate"))


def headroom(limits: DataFrame, now: Column) -> DataFrame:
    """Limits (kind, used_percent, cap, used, remaining, resets_at) with what is left of them, adding headroom, share, unit, exhausted, resets_in_ms.

    A window leaves 100 - used_percent (held to 0..100), a spend-cap cap - used, a balance (usd) and a
    credit-balance what remains; never less than 0. The share is of the whole: of 100, or of the cap (0 for a cap of 0 or less);
    balances have none. Other kinds have nothing left to tell: all null but exhausted, which is false. Without resets_at there is no wait.
    """
    kind = F.col("kind")
    left = (
        F.when(kind == "window", 100 - F.least(F.greatest(F.col("used_percent"), F.lit(0.0)), F.lit(100.0)))
        .when(kind == "spend-cap", F.col("cap") - F.col("used"))
        .when(kind.isin("balance", "credit-balance"), F.col("remaining"))
    )
    left = F.when(left.isNotNull(), F.greatest(left, F.lit(0.0)))
    wait = F.unix_millis(F.col("resets_at").cast("timestamp")) - F.unix_millis(now.cast("timestamp"))
    return limits.withColumns({
        "headroom": left,
        "share": F.when(kind == "window", left / 100).when(kind == "spend-cap", F.when(F.col("cap") > 0, left / F.col("cap")).otherwise(0.0)),
        "unit": F.when(kind == "window", "percent").when(kind.isin("spend-cap", "balance"), "usd").when(kind == "credit-balance", "credits"),
        "exhausted": F.coalesce(left <= 0, F.lit(False)),
        "resets_in_ms": F.when(F.col("resets_at").isNotNull(), F.greatest(wait, F.lit(0))),
    })


def valid_budgets(limits: DataFrame, account: str, order: str, now: Column) -> DataFrame:
    """The budget (account, cap, spent, remaining, share) of each account: its first limit of kind spend-cap, if that holds now.

    It holds with a finite cap of 0 or more and a finite amount used, once it has started and until it resets; one
    without a start or a reset always has. The share is what remains of the cap, 1 at most.
    """
    first = limits.filter("kind = 'spend-cap'").groupBy(account).agg(F.min(F.struct(order, "cap", "used", "starts_at", "resets_at")).alias("l")).select(account, "l.*")

    def finite(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    open_ = (F.col("starts_at").isNull() | (F.col("starts_at") <= now)) & (F.col("resets_at").isNull() | (F.col("resets_at") > now))
    left = F.greatest(F.col("cap") - F.col("used"), F.lit(0.0))
    good = first.filter(finite("cap") & finite("used") & (F.col("cap") >= 0) & open_)
    return good.select(account, "cap", F.col("used").alias("spent"), left.alias("remaining"), F.when(F.col("cap") > 0, F.least(left / F.col("cap"), F.lit(1.0))).otherwise(0.0).alias("share"))


def price_lookup(items: DataFrame, prices: DataFrame) -> DataFrame:
    """Price of each item (id, vendor): by vendor/id, else by the bare id where only one vendor has it."""
    full = prices.select("vendor", "id", F.col("price").alias("_full"))
    bare = prices.groupBy("id").agg(F.count("*").alias("_n"), F.min("price").alias("_bare")).filter("_n = 1").drop("_n")
    out = items.join(full, ["vendor", "id"], "left").join(bare, "id", "left")
    how = F.when(F.col("_full").isNotNull(), "vendor").when(F.col("_bare").isNotNull(), "unique-id").otherwise("none")
    return out.withColumn("price", F.coalesce("_full", "_bare")).withColumn("price_from", how).drop("_full", "_bare")


def enriched(catalog: DataFrame, other: DataFrame, key: str, fields: list[str], agree: list[str]) -> DataFrame:
    """Catalogue with missing fields filled from another one, only where all prices both have agree to 1e-9."""
    o = other.select(key, *[F.col(c).alias(f"_{c}") for c in {*fields, *agree}])
    same = F.lit(True)
    for c in agree:
        same &= F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= 1e-9, F.lit(True))
    out = catalog.join(o, key, "left")
    return out.withColumns({c: F.when(same, F.coalesce(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)) for c in fields}).drop(*[f"_{c}" for c in {*fields, *agree}])


def inside_runs(facts: DataFrame, runs: DataFrame, run: str, at: str) -> DataFrame:
    """Facts with inside: the time lies in its run's [created, ended or now]; facts of unknown runs count as inside."""
    r = runs.select(run, "created", "ended")
    out = facts.join(r.withColumn("_k", F.lit(True)), run, "left")
    inside = (F.col("created") <= F.col(at)) & (F.col("ended").isNull() | (F.col(at) <= F.col("ended")))
    return out.withColumn("inside", F.when(F.col("_k").isNull(), True).otherwise(F.coalesce(inside, F.lit(False)))).drop("_k", "created", "ended")
