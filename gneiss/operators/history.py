"""Statistics over an event history: one row for each (event, subject), with author, time and amounts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import distribution, ratio
from .deal import deal, large
from .graph import cut

#: Tasks over which the authors of one subject are dealt.
SLOTS = 64


@dataclass(frozen=True)
class History:
    """Names of the columns of an event history."""

    event: str
    subject: str
    author: str
    ts: str
    additions: str
    deletions: str | None = None


def churn(df: DataFrame, h: History, since: Column | None = None, rows: int | None = None) -> DataFrame:
    """Distinct events, amounts and authors of each subject since a time, first and last time of all history.

    The primary author has the most events in the window; of those that tie, the one whose last event there is the
    newest (of equal times the smallest event), as a log read from its newest event meets them.
    Subjects without an event in the window stay, with zero counts.
    With the number of rows, subjects and SLOTS parts of their authors are dealt by it (see deal()); a subject then has a row for each part.
    """
    inside = F.lit(True) if since is None else F.col(h.ts) >= since
    gone = F.col(h.deletions) if h.deletions else F.lit(0)
    facts = df.select(
        F.col(h.subject), F.col(h.event).alias("_e"), F.col(h.author).alias("_a"), F.col(h.ts).alias("_t"), F.col(h.additions).alias("_p"), gone.alias("_m"), inside.alias("_in")
    )
    kind = df.schema[h.ts].dataType.typeName()
    newest = F.unix_micros(F.col("_w").cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col("_w")
    # One partial result for each subject and author keeps the distinct counts small.
    single = facts.groupBy(h.subject, "_e", "_a").agg(F.min("_t").alias("_f"), F.max("_t").alias("_l"), F.sum(F.when(F.col("_in"), F.col("_p"))).alias("_p"), F.sum(F.when(F.col("_in"), F.col("_m"))).alias("_m"), F.max("_in").alias("_in"), F.max(F.when(F.col("_in"), F.col("_t"))).alias("_w"))
    slot = F.pmod(F.xxhash64("_a"), F.lit(SLOTS)) if large(rows) else F.lit(0)
    by_author = deal(single.withColumn("_slot", slot), rows, h.subject, "_slot").groupBy(h.subject, "_slot", "_a").agg(
        F.count(F.when(F.col("_in"), 1)).alias("_n"), F.sum("_p").alias("_p"), F.sum("_m").alias("_m"), F.min("_f").alias("_f"), F.max("_l").alias("_l"), F.min(F.when(F.col("_w").isNotNull(), F.struct((-newest).alias("w"), "_e"))).alias("_s")
    )
    seen = F.col("_n") > 0
    best = F.when(seen, F.struct((-F.col("_n")).alias("n"), F.col("_s").alias("s"), F.col("_a").alias("a")))
    parts = by_author.withColumns({"_k": F.when(seen, 1).otherwise(0), "_b": best})
    sums = [*[F.sum(c).alias(c) for c in ("_n", "_p", "_m", "_k")], F.min("_b").alias("_b"), F.min("_f").alias("_f"), F.max("_l").alias("_l")]
    if large(rows):
        parts = deal(parts.groupBy(h.subject, "_slot").agg(*sums), rows, h.subject)
    out = parts.groupBy(h.subject).agg(*sums).select(
        h.subject,
        F.col("_n").alias("commits"),
        F.coalesce("_p", F.lit(0)).alias("additions"),
        F.coalesce("_m", F.lit(0)).alias("deletions"),
        F.col("_k").alias("authors"),
        "_b",
        F.col("_f").alias("first_changed_at"),
        F.col("_l").alias("last_changed_at"),
    )
    return out.select(
        h.subject, "commits", "additions", "deletions", "authors", F.col("_b.a").alias("primary_author"), ratio(-F.col("_b.n"), F.col("commits")).alias("primary_share"), "first_changed_at", "last_changed_at"
    )


def totals_by_kind(df: DataFrame, h: History, kind: str, rows: int | None = None) -> DataFrame:
    """Distinct events and subjects and summed additions of each kind, and of all (kind null).

    A distinct event or subject of a kind is a row of its own, dealt by the number of rows where that is given (see deal()); no row is repeated for each count.
    """
    single = df.select(F.col(kind).alias("_k"), F.col(h.event).alias("_e"), F.col(h.subject).alias("_s"), F.col(h.additions).alias("_p"))
    by_event = deal(single, rows, "_e").groupBy("_e", "_k").agg(F.sum("_p").alias("_p"))
    by_subject = single.select("_s", "_k").distinct()
    # Of all: the events and subjects once, whatever their kinds.
    all_events = by_event.groupBy("_e").agg(F.sum("_p").alias("_p")).agg(F.count("_e").alias("commits"), F.count(F.lit(1)).alias("_n"), F.sum("_p").alias("additions"))
    all_subjects = by_subject.filter("_s is not null").select("_s").distinct().agg(F.count("*").alias("subjects"))
    total = all_events.filter("_n > 0").join(F.broadcast(all_subjects)).select(F.lit(None).cast(df.schema[kind].dataType).alias(kind), "commits", "subjects", "additions")  # one row each
    events = by_event.groupBy("_k").agg(F.count("_e").alias("commits"), F.sum("_p").alias("additions"))
    subjects = by_subject.groupBy(F.col("_k").alias("_j")).agg(F.count("_s").alias("subjects"))
    kinds = events.join(subjects, F.col("_k").eqNullSafe(F.col("_j"))).select(F.col("_k").alias(kind), "commits", "subjects", "additions")
    return kinds.union(total)


def distinct_events_over(df: DataFrame, h: History, subjects: DataFrame) -> DataFrame:
    """Number of events that touch any of the given subjects."""
    return df.join(subjects.select(h.subject).distinct(), h.subject, "left_semi").agg(F.countDistinct(h.event).alias("commits"))


def monthly_checkpoints(df: DataFrame, event: str, ts: str, k: int | None = None) -> DataFrame:
    """The last event of each month (UTC), ties by the larger event; the newest k months if k is given.

    The last event of all is the head and closes its month, so it is always among them.
    """
    last = F.max(F.struct(F.col(ts), F.col(event)))
    rows = df.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(last.alias("l")).select("month", F.col(f"l.{event}").alias(event))
    return rows if k is None else rows.orderBy(F.desc("month")).limit(max(1, k))


def spaced_checkpoints(df: DataFrame, event: str, ts: str, n: int) -> DataFrame:
    """At most n events evenly spaced by position: round(i last / (n - 1)); the last one alone for n = 1."""
    position = with_position(df, [ts, event], "pos")
    last = df.count() - 1
    n = min(max(1, n), last + 1)
    wanted = sorted({int(i * last / (n - 1) + 0.5) if n > 1 else last for i in range(n)})
    return position.filter(F.col("pos").isin(wanted))


def stride_checkpoints(df: DataFrame, event: str, ts: str, every: int, k: int) -> DataFrame:
    """Every `every`-th event from the last one back, k at most."""
    position = with_position(df, [ts, event], "pos")
    every, last = max(1, every), df.count() - 1
    back = F.lit(last) - F.col("pos")
    return position.filter((back % every == 0) & (back < every * max(1, k)))


def with_position(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense position from 0 over the whole table.

    Rows are range-sorted and checkpointed; each partition numbers its own and starts at the sum of
    the counts before it, so no task sees more than its range.
    """
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    rows = rows.withColumn("_p", F.shiftright("_m", 33))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_p", before.alias("_s")))
    return rows.join(starts, "_p").withColumn(name, F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_s")).drop("_m", "_p", "_s")


def rename_finals(renames: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """(old, final) for rename edges, however long their chains; names on a cycle, and those that lead to one, are left out.

    Names are followed by doubling: after r rounds a name points 2^r renames ahead, so a chain is at
    its end once that passes the number of renames, and what still moves then is on or before a cycle.
    """
    now = cut(renames.select(F.col(old).alias("old"), F.col(new).alias("final")).filter("old <> final").groupBy("old").agg(F.max("final").alias("final")).withColumn("moved", F.lit(True)))
    reach, most = 1, now.count()
    while reach <= 4 * most and not now.filter("moved").isEmpty():
        step = now.select(F.col("old").alias("final"), F.col("final").alias("next"))
        joined = now.filter("moved").join(step, "final", "left")
        moved = joined.select("old", F.coalesce("next", "final").alias("final"), F.col("next").isNotNull().alias("moved"))
        now = cut(now.filter("not moved").unionByName(moved))
        reach *= 2
    return now.filter("not moved").select("old", "final")


def lineage_intervals(df: DataFrame, subject: str, ts: str, alive: str, aliases: DataFrame | None = None) -> DataFrame:
    """[since, until) of each state of a subject whose `alive` flag changes; until is null for the last.

    With aliases (old, final) a renamed subject's rows belong to the lineage of its final name:
    (lineage, subject, since, until, alive), a new interval also where the name changes.
    """
    if aliases is None:
        w = Window.partitionBy(subject).orderBy(ts)
        changes = df.withColumn("_b", F.lag(alive).over(w)).filter(F.col("_b").isNull() | (F.col("_b") != F.col(alive)))
        return changes.select(subject, F.col(ts).alias("since"), F.lead(ts).over(w).alias("until"), alive)
    named = df.join(aliases.select(F.col("old").alias(subject), "final"), subject, "left").withColumn("lineage", F.coalesce("final", subject))
    w = Window.partitionBy("lineage").orderBy(ts)
    before = F.lag(F.struct(subject, alive)).over(w)
    changes = named.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.struct(subject, alive)))
    return changes.select("lineage", subject, F.col(ts).alias("since"), F.lead(ts).over(w).alias("until"), alive)
