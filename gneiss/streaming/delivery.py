"""Live delivery of a change log: consumers with retries and a stuck mark, observation of runs, appends with dense positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.graph import cut

#: The first and the longest delay of a retry, and how long a call may run.
FIRST_RETRY_MS, LONGEST_RETRY_MS, TIMEOUT_MS = 1_000, 300_000, 300_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIGNALS = "scope string, name string, at timestamp, seq long, signal string, position long"
#: Appends are numbered in this many rows a range and more.
RANGE_ROWS = 100_000


def with_timers(spark: SparkSession) -> None:
    """Set the state store that timers need; a running query keeps the one it started with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def heads(changes: DataFrame, consumers: DataFrame, scope: str, position: str, at: str) -> DataFrame:
    """Signals `appended` for the consumers (scope, name) of every scope that grows.

    Changes are reduced to one row a scope in each Arrow batch before anything is shuffled or joined, so a scope with a
    third of all changes costs its consumers a few rows a task. consumers holds a row for each registered consumer.
    """

    def largest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.groupby("scope", as_index=False).agg({"position": "max", "at": "max"})

    rows = changes.filter(F.col(scope).isNotNull() & F.col(position).isNotNull()).select(F.col(scope).cast("string").alias("scope"), F.col(position).cast("long").alias("position"), F.col(at).cast("timestamp").alias("at"))
    rows = rows.mapInPandas(largest, "scope string, position long, at timestamp")
    out = rows.join(consumers.select(F.col("scope").cast("string").alias("scope"), "name"), "scope")
    return out.select("scope", "name", "at", F.col("position").alias("seq"), F.lit("appended").alias("signal"), "position")


class _Consumer:
    """State of one consumer; times are milliseconds, None where nothing is set."""

    FIELDS = ("position", "head", "failures", "retry", "called", "timed", "clock", "shown")
    SCHEMA = "position long, head long, failures long, retry long, called long, timed boolean, clock long, shown string"

    def __init__(self, held: tuple | None, timeout: int):
        self.timeout = timeout
        for name, value in zip(self.FIELDS, held or (None, 0, 0, None, None, False, None, None), strict=True):
            setattr(self, name, value)

    def held(self) -> tuple:
        return tuple(getattr(self, name) for name in self.FIELDS)

    def wake(self) -> int | None:
        """The next time at which something happens without a signal."""
        if self.called is not None and not self.timed:
            return self.called + self.timeout
        return self.retry if self.retry is not None and (self.clock is None or self.retry > self.clock) else None

    def fail(self, at: int) -> None:
        self.failures += 1
        self.retry = at + min(FIRST_RETRY_MS << min(self.failures - 1, 30), LONGEST_RETRY_MS)

    def state(self) -> str:
        if self.called is not None:
            return "stuck" if self.timed else "busy"
        if self.position >= self.head:
            return "idle"
        return "waiting" if self.retry is not None and self.retry > self.clock else "due"

    def show(self, at: int) -> list[tuple]:
        """The row of this state, if it is another than the one shown last."""
        self.clock = at if self.clock is None else max(self.clock, at)
        if self.position is None:
            return []
        state = self.state()
        following = self.position + 1 if state == "due" else None
        mark = f"{state} {self.position} {self.failures} {self.retry}"
        if mark == self.shown:
            return []
        self.shown = mark
        return [(self.clock, state, following, self.position, self.failures, self.retry)]

    def advance(self, to: int) -> list[tuple]:
        """What happens by itself up to a time, included: calls run out of time, waits end."""
        out = []
        while (at := self.wake()) is not None and at <= to:
            if self.called is not None and not self.timed:
                self.timed = True
                self.fail(at)
            out += self.show(at)
        return out

    def signal(self, kind: str, at: int, position: int | None) -> list[tuple]:
        out = self.advance(at)
        if kind == "appended":
            self.head = max(self.head, position or 0)
        elif kind == "declared":
            if self.position is None:
                self.position = self.head if position is None else position
        elif self.position is None:
            return out  # not declared yet
        elif kind == "called":
            if self.called is None:
                self.called, self.timed = at, False
        elif kind == "moved":
            if self.called is None and position is not None and position > self.position:
                self.position, self.failures, self.retry = position, 0, None
        elif kind in ("completed", "failed"):
            if self.called is not None and not self.timed:
                if kind == "failed":
                    self.fail(at)
                else:
                    self.position, self.failures, self.retry = self.position if position is None else position, 0, None
            self.called, self.timed = None, False  # one that ran out of time only lets go
        return out + self.show(at)


class _Deliveries(StatefulProcessor):
    COLUMNS = ("at", "state", "next", "position", "failures", "retry_at")

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("consumer", _Consumer.SCHEMA)

    def _rows(self, key: tuple, consumer: _Consumer, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        self.kept.update(consumer.held())
        wake = consumer.wake()
        if wake is not None:
            self.handle.registerTimer(wake)  # a timer that is overtaken finds nothing to do
        if rows:
            out = pd.DataFrame(rows, columns=list(self.COLUMNS))
            for c in ("at", "retry_at"):
                out[c] = pd.to_datetime(out[c].astype("Int64"), unit="ms")
            out["next"] = out["next"].astype("Int64")
            out.insert(0, "name", key[1])
            out.insert(0, "scope", key[0])
            yield out

    def _consumer(self) -> _Consumer:
        return _Consumer(tuple(self.kept.get()) if self.kept.exists() else None, self.timeout)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        consumer, out = self._consumer(), []
        frame = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        times = frame["at"].astype("datetime64[us]").astype("int64") // 1000
        for kind, at, position in zip(frame["signal"], times, frame["position"], strict=True):
            out += consumer.signal(kind, int(at), None if pd.isna(position) else int(position))
        yield from self._rows(key, consumer, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        consumer = self._consumer()
        yield from self._rows(key, consumer, consumer.advance(expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def deliveries(signals: DataFrame, delay: str = "10 seconds", timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """Every change of state of every consumer: (scope, name, at, state, next, position, failures, retry_at).

    Signals are (scope, name, at, seq, signal, position), taken in the order of `at`, then `seq`: declared (at a position, or
    at the head), appended (the head), called, completed, failed, moved (past changes of other types). The states are those of
    operators.log.due(), and the last row of a consumer is its state at the watermark:

    * A failed consumer waits 1 s, doubled with each failure in a row up to 5 minutes, and holds back what comes after;
      others go on. Success and moves start the count again.
    * A call that has run for `timeout_ms` is stuck and has failed: its wait runs, but it is not called again before the call
      settles. What it settles with does not count.
    * Waits and calls end by timers of the event time, or before a later signal that comes first, so how signals are cut
      into batches and where a query is restarted does not change the rows, as long as the signals of a consumer arrive in
      order over batches. Of one time, what ends by itself comes first.
    * Signals before the declaration but heads count for nothing, unknown signals neither; rows with a null key or time are
      left out, those that lie `delay` or more behind the newest time of earlier batches are dropped, as Spark does.

    State is one row a consumer. The signals of one consumer in one batch are sorted in one task: a call has two.
    """
    spark = signals.sparkSession
    with_timers(spark)
    rows = signals.filter("scope is not null and name is not null and at is not null and signal is not null")
    rows = rows.select("scope", "name", F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "signal", F.col("position").cast("long").alias("position")).withWatermark("at", delay)
    schema = "scope string, name string, at timestamp, state string, next long, position long, failures long, retry_at timestamp"
    return rows.groupBy("scope", "name").transformWithStateInPandas(_Deliveries(timeout_ms), schema, "Append", "EventTime")


class ReplayGap(RuntimeError):
    """Frames between the cursor of an observer and the frame that came are not there any more."""


class _Observation(StatefulProcessor):
    def __init__(self, first: int, fails: bool):
        self.first, self.fails = first, fails

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("cursor", "next long, closed boolean")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        self.kept.update((int(initialState["after"].iloc[0]) + 1, False))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        following, closed = self.kept.get() if self.kept.exists() else (self.first, False)
        frame = pd.concat(list(rows)).sort_values(["cursor", "terminal", "payload"]).drop_duplicates("cursor")
        out = []
        for cursor, terminal, payload in zip(frame["cursor"], frame["terminal"], frame["payload"], strict=True):
            if closed or cursor < following:
                continue
            if cursor > following:
                text = f"run {key[0]}: expected frame {following}, found {cursor}"
                if self.fails:
                    raise ReplayGap(text)
                out.append((following, "gap", text))
                closed = True
                continue
            closed, following = bool(terminal), int(cursor) + 1
            out.append((cursor, "closing" if closed else "frame", payload))
        self.kept.update((following, closed))
        if out:
            result = pd.DataFrame(out, columns=["cursor", "event", "payload"])
            result.insert(0, "run", key[0])
            yield result

    def close(self) -> None:
        pass


def observed(frames: DataFrame, cursors: DataFrame | None = None, after: int = -1, on_gap: str = "fail") -> DataFrame:
    """Frames (run, cursor, terminal, payload) of each run behind its cursor, replayed and then tailed: (run, cursor, event, payload).

    A run starts behind its row of cursors (run, after), or behind `after`. Frames up to there, and frames that come again,
    are passed over, so a restart repeats and loses nothing; of several in one batch one that ends nothing counts, then the
    smallest payload. The terminal frame is the event `closing` and ends its run:
    nothing later is given out. A missing frame fails the query, or with on_gap="mark" ends its run with the event `gap`
    (cursor: the frame that is missing) while other runs go on. A null run or cursor is left out, a null terminal is false.

    The frames of a run are to arrive in order over batches; within one they are sorted. operators.log.replay_gaps() checks cursors beforehand.
    A table is one batch and leaves no state, so its runs are sorted in one shuffle, without a call for each run; the rows are the same.
    """
    if on_gap not in ("fail", "mark"):
        raise ValueError("on_gap is fail or mark")
    if after < -1:
        raise ValueError("a cursor is -1 or more")
    rows = frames.filter("run is not null and cursor is not null")
    rows = rows.select(F.col("run").cast("string").alias("run"), F.col("cursor").cast("long").alias("cursor"), F.coalesce("terminal", F.lit(False)).alias("terminal"), F.col("payload").cast("string").alias("payload"))
    first = None
    if cursors is not None:
        first = cursors.filter("run is not null").groupBy(F.col("run").cast("string").alias("run")).agg(F.max("after").cast("long").alias("after")).na.fill(after, ["after"])
    if not rows.isStreaming:
        return _observed_table(rows, first, after, on_gap == "fail")
    with_timers(frames.sparkSession)
    initial = None if first is None else first.groupBy("run")
    return rows.groupBy("run").transformWithStateInPandas(_Observation(after + 1, on_gap == "fail"), "run string, cursor long, event string, payload string", "Append", "None", initial)


def _observed_table(rows: DataFrame, first: DataFrame | None, after: int, fails: bool) -> DataFrame:
    """observed() of a table: a run is given out up to its first frame that is terminal or does not follow the one before."""
    start = F.lit(after).cast("long")
    rows = rows.withColumn("after", start) if first is None else rows.join(first, "run", "left").withColumn("after", F.coalesce("after", start))
    best = F.min(F.struct("terminal", F.col("payload").isNull().alias("_none"), "payload")).alias("b")
    kept = rows.filter("cursor > after").groupBy("run", "after", "cursor").agg(best).select("run", "after", "cursor", "b.terminal", "b.payload")
    w = Window.partitionBy("run").orderBy("cursor")  # rows of a run are sorted and read in turn, both spill
    kept = kept.withColumn("_next", F.coalesce(F.lag("cursor").over(w), "after") + 1).withColumn("_lost", F.col("cursor") > F.col("_next"))
    ended = F.max(F.col("terminal") | F.col("_lost")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = kept.withColumn("_ended", ended).filter("not coalesce(_ended, false)")
    text = F.format_string("run %s: expected frame %d, found %d", "run", "_next", "cursor")
    if fails:
        kept = kept.filter(F.when(F.col("_lost"), F.raise_error(text).cast("boolean")).otherwise(True))
    event = F.when(F.col("_lost"), "gap").when(F.col("terminal"), "closing").otherwise("frame")
    return kept.select("run", F.when(F.col("_lost"), F.col("_next")).otherwise(F.col("cursor")).alias("cursor"), event.alias("event"), F.when(F.col("_lost"), text).otherwise(F.col("payload")).alias("payload"))


def _numbered(rows: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """Dense numbers from 1 in each scope: counted by range, numbered inside a range, so that no scope is one task."""
    n = rows.count()
    parts = max(1, -(-n // RANGE_ROWS))
    if parts == 1:
        return rows.withColumn("_i", F.row_number().over(Window.partitionBy(scope).orderBy(*order)).cast("long"))
    ranged = cut(rows.repartitionByRange(parts, scope, *order).withColumn("_r", F.spark_partition_id()))
    counts = ranged.groupBy(scope, "_r").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(scope).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(F.col(scope).alias("_s"), F.col("_r").alias("_q"), "_b")
    inside = ranged.withColumn("_i", F.row_number().over(Window.partitionBy(scope, "_r").orderBy(*order)))
    out = inside.join(before, inside[scope].eqNullSafe(before["_s"]) & (inside["_r"] == before["_q"]))
    return out.withColumn("_i", F.col("_i") + F.col("_b")).drop("_s", "_q", "_b", "_r")


def append_to(root: str, scope: str, order: list[str], keep: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler that appends rows to the log at root with dense positions in each scope, once for each batch id.

    The result equals operators.log.appended() batch after batch. A batch writes the folder of its own id and then the heads
    behind it; it starts from the heads of the batch before it, so one that is run again writes what it wrote before,
    and readers see a batch once its heads are there. `order` must tell the rows of a scope apart. Heads
    are a row for each scope. Rows that fail `keep` and rows without a scope are left out.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.col(scope).isNotNull())
        rows = cut(rows.filter(keep) if keep is not None else rows)
        behind = _last(spark, root, batch_id)
        known = spark.read.parquet(f"{root}/heads/{behind}") if behind is not None else rows.select(scope, F.lit(0).cast("long").alias("head")).limit(0)
        out = _numbered(rows, scope, order).join(known.withColumnRenamed("head", "_h"), scope, "left")
        out = out.withColumn("position", F.col("_i") + F.coalesce("_h", F.lit(0))).select(*batch.columns, "position")
        out.write.mode("overwrite").parquet(f"{root}/log/batch={batch_id}")
        grown = rows.groupBy(scope).agg(F.count("*").alias("head"))
        known.union(grown).groupBy(scope).agg(F.sum("head").alias("head")).write.mode("overwrite").parquet(f"{root}/heads/{batch_id}")

    return handle


def _last(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """The last batch id with heads, below `before`."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/heads")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [s.getPath() for s in fs.listStatus(folder)]
    done = [int(p.getName()) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max((b for b in done if before is None or b < before), default=None)


def appended_log(spark: SparkSession, root: str) -> DataFrame:
    """The log that append_to() wrote, up to the last whole batch."""
    last = _last(spark, root)
    if last is None:
        raise FileNotFoundError(f"no appended batch in {root}")
    return spark.read.option("basePath", f"{root}/log").parquet(f"{root}/log").filter(F.col("batch") <= last).drop("batch")
