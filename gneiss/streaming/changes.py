"""Streaming forms of the change log, with the same results as the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.log import ENTERED


def deliver(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """At-least-once delivery up to the captured head: offsets live in the checkpoint, the query ends when caught up."""
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_events(stream: DataFrame, key: str, order: str, status: str, fields: list[str] = (), times: str | None = None) -> DataFrame:
    """The events of operators.log.change_events(), the last state of each key kept between batches.

    Fields are held as text; a batch's states of a key are compared as whole columns.
    """
    kind, names = stream.schema[key].dataType.simpleString(), sorted(fields)
    columns = [status, *names]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order)
        now = rows[columns].astype(object).where(rows[columns].notna(), None).reset_index(drop=True)
        first = pd.DataFrame([state.get if state.exists else [None] * len(columns)], columns=columns, dtype=object)
        was = pd.concat([first, now.iloc[:-1]], ignore_index=True)
        at, here, before = rows[order].to_numpy(), now[status].notna(), was[status].notna()
        both = here & before
        moved = both & (now[status] != was[status])
        out = [(at[here & ~before], "queued", ""), (at[~here & before], "removed", "")]
        for name in now[status][moved].unique():
            out.append((at[moved & (now[status] == name)], ENTERED.get(name, f"entered {name}"), ""))
        marks = pd.Series("", index=now.index)
        for f in names:
            differs = both & (now[f] != was[f]) & ~(now[f].isna() & was[f].isna()) & ~(moved & (f == times))
            marks = marks.where(~differs, marks.where(marks == "", marks + ",") + f)
        for text in marks[marks != ""].unique():
            out.append((at[marks == text], "updated", text))
        state.update(tuple(now.iloc[-1]))
        yield pd.concat([pd.DataFrame({key: k[0], order: a, "event": e, "changed": c}) for a, e, c in out])

    rows = stream.select(key, F.col(order).cast("long").alias(order), *[F.col(c).cast("string").alias(c) for c in columns])
    held = ", ".join(f"`{c}` string" for c in columns)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} long, event string, changed string", held, "append", GroupStateTimeout.NoTimeout)


def claimed_once(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, by: str, value: str, width: str, delay: str) -> DataFrame:
    """Extension: counts and sums by tumbling event-time window and key; rows later than delay are dropped."""
    rows = stream.withWatermark(ts, delay).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, ts: str, by: str, gap: str, delay: str) -> DataFrame:
    """Extension: sessions of a key that end after a gap."""
    rows = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")
