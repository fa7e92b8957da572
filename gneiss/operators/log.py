"""An ordered change log as tables: offsets, gaps, retries, retention, change events, conversation budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import retry_delay_ms

LOG_RANGES = 1024


def read_after(log: DataFrame, position: str, after: int, kinds: list[str] | None = None, kind: str = "type", limit: int = 100) -> DataFrame:
    rows = log.filter(F.col(position) > after)
    return (rows.filter(F.col(kind).isin(kinds)) if kinds else rows).orderBy(position).limit(limit)


def catch_up(log: DataFrame, consumers: DataFrame, position: str, kind: str) -> DataFrame:
    """For each consumer (name, position, types or null): deliveries up to the head, and its new position.

    Deliveries are counted, not listed: rows are totalled by type and by ranges of positions, whole
    ranges are added up, and only the range a consumer stands in is looked at row by row.
    """
    ends = log.agg(F.max(position).alias("head"), F.min(position).alias("_lo"))  # one row
    width = F.greatest(F.lit(1), F.ceil((F.col("head") - F.col("_lo") + 1) / LOG_RANGES)).cast("long")
    rows = log.select(F.col(position).alias("_p"), F.col(kind).alias("_k")).join(F.broadcast(ends)).withColumn("_r", F.floor((F.col("_p") - F.col("_lo")) / width).cast("long"))
    totals = rows.groupBy("_k", "_r").agg(F.count("*").alias("_n"))
    every = totals.groupBy("_r").agg(F.sum("_n").alias("_n")).withColumn("_k", F.lit(None).cast("string"))
    totals = totals.withColumn("_all", F.lit(False)).unionByName(every.withColumn("_all", F.lit(True)))
    w = Window.partitionBy("_k", "_all").orderBy("_r").rowsBetween(1, Window.unboundedFollowing)  # LOG_RANGES rows of a type at most
    later = totals.withColumn("_after", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    c = consumers.join(F.broadcast(ends))
    c = c.withColumns({"_all": F.col("types").isNull(), "_k": F.explode(F.coalesce("types", F.array(F.lit(None).cast("string"))))})
    c = c.withColumn("_r", F.floor((F.col("position") - F.col("_lo")) / width).cast("long"))
    spans = later.select("_k", "_all", F.col("_r").alias("_at"), (F.col("_n") + F.col("_after")).alias("_from"))
    near = c.select("name", "position", "_all", F.col("_k").alias("_type"), "_r")
    whole = near.join(spans.withColumnRenamed("_k", "_type2").withColumnRenamed("_all", "_all2"), F.col("_type").eqNullSafe(F.col("_type2")) & (F.col("_all") == F.col("_all2")) & (F.col("_at") > F.col("_r"))).groupBy("name", "_type", "_all").agg(F.max("_from").alias("d"))
    typed = near.filter("not _all").join(rows.withColumnRenamed("_r", "_row_r"), (F.col("_type") == F.col("_k")) & (F.col("_r") == F.col("_row_r"))).filter("_p > position")
    plain = near.filter("_all").join(rows.withColumnRenamed("_r", "_row_r"), F.col("_r") == F.col("_row_r")).filter("_p > position")
    inside = typed.select("name").union(plain.select("name")).groupBy("name").agg(F.count("*").alias("_i"))
    sums = whole.groupBy("name").agg(F.sum("d").alias("_w"))
    out = consumers.join(F.broadcast(ends)).join(sums, "name", "left").join(inside, "name", "left")
    return out.select("name", (F.coalesce("_w", F.lit(0)) + F.coalesce("_i", F.lit(0))).alias("delivered"), F.greatest("head", "position").alias("position"))


def missed_ranges(moves: DataFrame, compacted: int) -> DataFrame:
    """[missed_from, missed_through] of moves (name, from, to, handed) over the compacted part of the log.

    A move ends at `to`; where that row was handed over it was not missed, so the range ends before it. Nothing is missed by a move that
    starts at or after the end of the range.
    """
    last = F.when(F.coalesce("handed", F.lit(False)), F.col("to") - 1).otherwise(F.col("to"))
    rows = moves.withColumn("missed_through", F.least(F.lit(compacted).cast("long"), last)).filter(F.col("missed_through") > F.col("from"))
    return rows.select("name", (F.col("from") + 1).alias("missed_from"), "missed_through")


def gaps(df: DataFrame, by: list[str], cursor: str, first: int = 0) -> DataFrame:
    """Rows whose cursor is not the one after the row before (from `first` on)."""
    w = Window.partitionBy(*by).orderBy(cursor)
    return df.withColumn("expected", F.coalesce(F.lag(cursor).over(w) + 1, F.lit(first))).filter(F.col("expected") != F.col(cursor)).select(*by, "expected", F.col(cursor).alias("found"))


def retry_schedule(df: DataFrame, failures: str, failed_at: str) -> DataFrame:
    """Delay and time of the next attempt after a number of failures."""
    delay = retry_delay_ms(F.col(failures))
    return df.withColumn("delay_ms", delay).withColumn("retry_at", F.timestamp_millis(F.unix_millis(F.col(failed_at).cast("timestamp")) + delay))


def retention(log: DataFrame, position: str, ts: str, cutoff: Column, slowest: int, step: int | None = None) -> DataFrame:
    """Rows that may go: before the first young row and not beyond the slowest consumer; the first `step` of them."""
    young = log.agg(F.min(F.when(F.col(ts) >= cutoff, F.col(position))).alias("_y"))  # one row
    rows = log.join(F.broadcast(young)).filter((F.col(position) <= slowest) & (F.col("_y").isNull() | (F.col(position) < F.col("_y")))).drop("_y")
    return rows if step is None else rows.orderBy(position).limit(step)


def appended(rows: DataFrame, heads: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """New rows with dense positions after the head (scope, head) of each scope; a new scope starts at 1."""
    w = Window.partitionBy(scope).orderBy(*order)
    out = rows.join(heads.select(scope, "head"), scope, "left")
    return out.withColumn("position", F.row_number().over(w) + F.coalesce("head", F.lit(0))).drop("head")


def declared(consumers: DataFrame, wanted: DataFrame, log: DataFrame, position: str, now: Column) -> DataFrame:
    """Consumers (name, position, seen_at) after declaring (name): known ones keep their position, new ones start at the head."""
    head = log.agg(F.coalesce(F.max(position), F.lit(0)).alias("_h"))  # one row
    out = consumers.join(wanted.select("name", F.lit(True).alias("_w")), "name", "full_outer").join(F.broadcast(head))
    return out.select("name", F.coalesce("position", "_h").alias("position"), F.when(F.col("_w"), now).otherwise(F.col("seen_at")).alias("seen_at"))


def moved(consumers: DataFrame, moves: DataFrame) -> DataFrame:
    """Consumers (name, position, claim) after moves (name, from, to, claim): only from where they stand and under the claim they hold."""
    m = moves.select("name", F.col("from").alias("_f"), F.col("to").alias("_t"), F.col("claim").alias("_c"))
    good = (F.col("position") == F.col("_f")) & (F.col("claim") == F.col("_c"))
    out = consumers.join(m, "name", "left")
    return out.select("name", F.when(good, F.col("_t")).otherwise(F.col("position")).alias("position"), "claim", F.coalesce(good, F.lit(False)).alias("moved"))


def due(consumers: DataFrame, log: DataFrame, position: str, now: Column, timeout_ms: int = 300_000) -> DataFrame:
    """State of each consumer (name, position, retry_at, called_at): stuck, busy, waiting, idle or due.

    A call that has run for the timeout is stuck; one that runs is busy; a failed consumer waits for
    its own time and holds back what comes after, while others go on; one at the head is idle.
    """
    head = log.agg(F.coalesce(F.max(position), F.lit(0)).alias("_h"))  # one row
    ran = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("called_at").cast("timestamp"))
    state = F.when(ran >= timeout_ms, "stuck").when(F.col("called_at").isNotNull(), "busy").when(F.col("position") >= F.col("_h"), "idle").when(F.col("retry_at") > now, "waiting").otherwise("due")
    return consumers.join(F.broadcast(head)).select("name", state.alias("state"), F.when(state == "due", F.col("position") + 1).alias("next"))


def ticks(schedules: DataFrame, now: Column) -> DataFrame:
    """Due schedules (key, next_due, every_ms, held_by): run with the time of their next tick, or skipped because they are held."""
    run = F.col("held_by").isNull()
    again = F.timestamp_millis(F.unix_millis(now.cast("timestamp")) + F.col("every_ms"))
    rows = schedules.filter(F.col("next_due") <= now)
    return rows.select("key", F.when(run, "run").otherwise(F.concat(F.lit("held by "), "held_by")).alias("outcome"), F.when(run, again).alias("next_due"))


def replay_gaps(frames: DataFrame, cursors: DataFrame) -> DataFrame:
    """(run, after, earliest, latest) of the cursors (run, after) that cannot be replayed from the frames (run, cursor) still held.

    Either frames behind the cursor are gone, or the cursor is beyond the last one. A null `after` is -1, the start; a run
    without frames is held from 0 to -1. Frames are reduced to a row for each run before they meet the cursors.
    """
    held = frames.groupBy("run").agg(F.min("cursor").alias("_e"), F.max("cursor").alias("_l"))
    rows = cursors.select("run", F.coalesce("after", F.lit(-1)).cast("long").alias("after")).join(held, "run", "left")
    rows = rows.select("run", "after", F.coalesce("_e", F.lit(0)).cast("long").alias("earliest"), F.coalesce("_l", F.lit(-1)).cast("long").alias("latest"), "_e")
    return rows.filter(F.coalesce(F.col("_e") > F.col("after") + 1, F.lit(False)) | (F.col("after") > F.col("latest"))).drop("_e")


def frame_faults(frames: DataFrame) -> DataFrame:
    """(run, cursor, fault) of frames (run, cursor, kind, evidence): kind terminal or other.

    out-of-order where the cursor is not its place from 0; second-terminal after a terminal frame;
    late-activity for other frames after it that are no evidence.
    """
    w = Window.partitionBy("run").orderBy("cursor")
    before = F.max((F.col("kind") == "terminal").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)) == 1
    rows = frames.withColumns({"_i": F.row_number().over(w) - 1, "_t": F.coalesce(before, F.lit(False))})
    fault = F.when(F.col("cursor") != F.col("_i"), "out-of-order").when(F.col("_t") & (F.col("kind") == "terminal"), "second-terminal").when(F.col("_t") & ~F.col("evidence"), "late-activity")
    return rows.select("run", "cursor", fault.alias("fault")).filter("fault is not null")


#: The event that entering a status is, and keys of metadata that the runtime keeps for itself.
RUNTIME_METADATA = ("stream", "workflow", "workflows.execution")
ENTERED = {"cancelled": "cancelled", "complete": "completed", "failed": "failed", "queued": "resumed", "running": "started", "suspended": "parked"}


def change_events(states: DataFrame, key: str, order: str, status: str, fields: list[str], times: str | None = None, metadata: str | None = None) -> DataFrame:
    """(key, order, event, changed) between following states of a key; a null status is a state in which it is gone.

    A key that comes into being is queued, one that goes is removed. Between two states that are
    there, a status move gives the event of the status entered, and changed fields give updated with
    their names; one step may give both. A move hides a change of the field named `times`; of the map
    named `metadata` the runtime's own keys are no change.
    """
    if metadata:
        own = F.map_filter(metadata, lambda k, _: ~k.isin(*RUNTIME_METADATA))
        states = states.withColumn(metadata, F.array_sort(F.map_entries(own)))  # maps don't compare
    w = Window.partitionBy(key).orderBy(order)
    rows = states.withColumn("_b", F.lag(F.struct(status, *fields)).over(w))
    was, now = F.col(f"_b.{status}"), F.col(status)
    moved = was != now

    def differs(f: str) -> Column:
        new = ~F.col(f"_b.{f}").eqNullSafe(F.col(f))
        return new & ~moved if f == times else new

    changed = F.array_join(F.array_compact(F.array(*[F.when(differs(f), F.lit(f)) for f in sorted(fields)])), ",")
    entered = F.lit(None).cast("string")
    for name, event in ENTERED.items():
        entered = F.when(now == name, event).otherwise(entered)
    there = was.isNotNull() & now.isNotNull()
    def event(name: Column, fields_: Column) -> Column:
        return F.struct(name.alias("event"), fields_.alias("changed"))

    nothing = F.lit("")
    events = F.array(
        F.when(was.isNull() & now.isNotNull(), event(F.lit("queued"), nothing)),
        F.when(was.isNotNull() & now.isNull(), event(F.lit("removed"), nothing)),
        F.when(there & moved, event(F.coalesce(entered, F.concat(F.lit("entered "), now)), nothing)),
        F.when(there & (changed != ""), event(F.lit("updated"), changed)),
    )
    return rows.select(key, order, F.explode(F.array_compact(events)).alias("e")).select(key, order, "e.event", "e.changed")


def velocity(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Change of a value against the row before of the same key."""
    return df.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order)))


def trailing_count(df: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """Rows of the key in the trailing interval up to each row, itself included."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(by).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("recent", F.count("*").over(w))


def budget_cut(df: DataFrame, by: str, order: str, role: str, tokens: Column, keep: int, pending: str | None = None) -> DataFrame:
    """First position kept of each conversation: the newest rows that reach `keep` tokens, moved on to the next user turn.

    Conversations without a user turn from there on, and those kept from their first row, are left
    out. `pending` names a flag of rows that ask for an approval nobody has given: an earlier one of
    these is kept too.
    """
    w = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    held = F.col(pending) if pending else F.lit(False)
    run = df.select(by, F.col(order).alias("_o"), F.col(role).alias("_r"), held.alias("_p"), F.sum(tokens).over(w).alias("_s"))
    cut = run.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("_s") >= keep, F.col("_o"))), F.min("_o")).alias("_c"), F.min("_o").alias("_f"), F.min(F.when(F.col("_p"), F.col("_o"))).alias("_a"))
    moved_ = run.join(cut, by).filter((F.col("_o") >= F.col("_c")) & (F.col("_r") == "user")).groupBy(by).agg(F.min("_o").alias("_u"), F.first("_f").alias("_f"), F.first("_a").alias("_a"))
    first = F.least("_u", "_a")
    return moved_.select(by, first.alias("first_kept"), "_f").filter("first_kept > _f").drop("_f")


def message_tallies(df: DataFrame, session: str, role: str, counted: str) -> DataFrame:
    return df.groupBy(session).agg(F.count("*").alias("messages"), F.sum((F.col(role) == counted).cast("long")).alias("counted"))


def claimed_once(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key: effects that were claimed."""
    rest = [c for c in df.columns if c != key and c not in order]
    return df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]])
