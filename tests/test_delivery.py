"""Live delivery: consumers with timers against a simulation and the batch states, observed runs over restarts, replayed appends."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from gneiss.operators import log
from gneiss.streaming import delivery

START = dt.datetime(2024, 1, 1)
COLUMNS = ["scope", "name", "at", "seq", "signal", "position"]


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


def write(spark, rows, folder, n, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{n:03d}")
    for name in os.listdir(f"{folder}/{n:03d}"):
        os.utime(f"{folder}/{n:03d}/{name}", (1000 + n, 1000 + n))


def run(stream, checkpoint, handle):
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(180)


def signals(seed, consumers=4, steps=14):
    """Signals of consumers that keep the rules, and where each one stands: (position, failures, retry, called)."""
    rng, rows, state, head, seq = random.Random(seed), [], {}, 0, 0
    for c in range(consumers):
        state[c] = {"position": 0, "failures": 0, "retry": None, "called": None}
        rows.append(("s", f"c{c}", at(0), c, "declared", 0))
    clock = 0
    for _ in range(steps):
        clock += rng.choice([500, 3_000, 40_000, 200_000])
        head += rng.randrange(3)
        for c, s in state.items():
            clock, seq = clock + 10, seq + 1
            rows.append(("s", f"c{c}", at(clock), seq, "appended", head))
            if s["called"] is None:
                if s["position"] < head and (s["retry"] is None or s["retry"] <= clock):
                    clock += 5
                    s["called"] = clock
                    rows.append(("s", f"c{c}", at(clock), seq, "called", s["position"] + 1))
                continue
            if rng.random() < 0.35:
                continue  # runs on
            clock, kind = clock + 7, rng.choice(["completed", "failed", "failed"])
            out_of_time = s["called"] + 300_000 <= clock
            rows.append(("s", f"c{c}", at(clock), seq, kind, s["position"] + 1))
            if out_of_time or kind == "failed":
                s["failures"] += 1
                s["retry"] = (s["called"] + 300_000 if out_of_time else clock) + min(1000 * 2 ** (s["failures"] - 1), 300_000)
            else:
                s["position"], s["failures"], s["retry"] = s["position"] + 1, 0, None
            s["called"] = None
    return rows, state, head, clock


@pytest.mark.parametrize("seed", [1, 5])
def test_streamed_deliveries_equal_the_batch_states(spark, tmp_path, seed):
    rows, state, head, clock = signals(seed)
    end = clock + 20_000
    results = []
    for batches in (1, 4):
        folder, checkpoint = str(tmp_path / f"in{batches}"), str(tmp_path / f"check{batches}")
        size, out = -(-len(rows) // batches), []
        for b in range(batches + 1):
            part = rows[b * size : b * size + size] if b < batches else [("s", "other", at(end), 0, "appended", 0)]
            write(spark, part, folder, b, delivery.SIGNALS)
            if b % 2 == 0 or b == batches:  # every other batch in a query of its own
                stream = spark.readStream.schema(delivery.SIGNALS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
                run(delivery.deliveries(stream, "0 seconds"), checkpoint, lambda df, _, out=out: out.extend(map(tuple, df.collect())))
        results.append(sorted(out, key=lambda r: (r[1], r[2])))
    assert results[0] == results[1] and {r[3] for r in results[0]} >= {"busy", "waiting", "due"}
    last = {r[1]: (r[3], r[4]) for r in results[0]}
    assert {r[1]: r[5] for r in results[0]} == {f"c{c}": s["position"] for c, s in state.items()}
    failures = {f"c{c}": s["failures"] + int(s["called"] is not None and s["called"] + 300_000 <= end) for c, s in state.items()}
    assert {r[1]: r[6] for r in results[0]} == failures
    schema = "name string, position long, retry_at timestamp, called_at timestamp"
    table = [(f"c{c}", s["position"], s["retry"] and at(s["retry"]), s["called"] and at(s["called"])) for c, s in state.items()]
    changes = spark.createDataFrame([(head,)], "position long")
    want = log.due(spark.createDataFrame(table, schema), changes, "position", F.lit(at(end)))
    assert last == {r.name: (r.state, r.next) for r in want.collect()}


def test_stuck_calls_and_waits(spark, tmp_path):
    minute = 60_000
    rows = [
        ("s", "a", at(0), 0, "declared", 0), ("s", "a", at(0), 1, "appended", 3), ("s", "a", at(10), 2, "called", 1),
        ("s", "a", at(6 * minute), 3, "completed", 1), ("s", "a", at(6 * minute + 5), 4, "called", 1), ("s", "a", at(6 * minute + 9), 5, "completed", 1),
        ("s", "a", at(7 * minute), 6, "moved", 3),
        ("s", "b", at(0), 7, "declared", None), ("s", "b", at(1), 8, "appended", 1), ("s", "b", at(2), 9, "called", 1), ("s", "b", at(3), 10, "failed", 1),
        ("s", None, at(3), 11, "called", 1), ("s", "c", at(3), 12, "called", 1), ("s", "c", None, 12, "called", 1), ("s", "b", at(3), 13, "strange", None),
        ("s", "z", at(20 * minute), 14, "appended", 1),
    ]
    write(spark, rows, str(tmp_path / "in"), 0, delivery.SIGNALS)
    stream = spark.readStream.schema(delivery.SIGNALS).parquet(str(tmp_path / "in/*"))
    out = []
    run(delivery.deliveries(stream), str(tmp_path / "check"), lambda df, _: out.extend(df.collect()))
    seen = {n: [((r["at"] - START) // dt.timedelta(milliseconds=1), r.state, r.next, r.position, r.failures) for r in sorted(out, key=lambda r: r["at"]) if r.name == n] for n in "abcz"}
    assert seen["a"] == [
        (0, "idle", None, 0, 0), (0, "due", 1, 0, 0), (10, "busy", None, 0, 0), (5 * minute + 10, "stuck", None, 0, 1),
        (6 * minute, "due", 1, 0, 1), (6 * minute + 5, "busy", None, 0, 1), (6 * minute + 9, "due", 2, 1, 0), (7 * minute, "idle", None, 3, 0),
    ]
    assert seen["b"] == [(0, "idle", None, 0, 0), (1, "due", 1, 0, 0), (2, "busy", None, 0, 0), (3, "waiting", None, 0, 1), (1003, "due", 1, 0, 1)]
    assert seen["c"] == [] and seen["z"] == []


def test_heads_are_reduced_before_they_are_dealt(spark):
    changes = spark.createDataFrame([("s", i, at(i)) for i in range(1, 500)] + [("t", 7, at(7)), (None, 8, at(8))], "sc string, p long, t timestamp").coalesce(1)
    consumers = spark.createDataFrame([("s", "a"), ("s", "b"), ("u", "c")], "scope string, name string")
    got = sorted(map(tuple, delivery.heads(changes, consumers, "sc", "p", "t").collect()))
    assert got == [("s", n, at(499), 499, "appended", 499) for n in "ab"]


FRAMES = "run string, cursor long, terminal boolean, payload string, extra int"


def test_observed_runs_over_restarts(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []
    batches = [
        [("a", 0, False, "a0", 1), ("a", 1, None, "a1", 1), ("b", 3, False, "b3", 1), ("b", 2, False, "b2", 1), ("c", 0, True, "c0", 1), (None, 0, False, "", 1), ("a", None, False, "", 1)],
        [("a", 1, False, "again", 1), ("a", 2, False, "a2", 1), ("b", 4, True, "b4", 1), ("c", 1, False, "late", 1), ("d", 1, False, "d1", 1)],
        [("a", 3, True, "a3", 1), ("b", 5, False, "late", 1), ("d", 2, True, "d2", 1)],
    ]
    cursors = spark.createDataFrame([("b", 2), ("c", None)], "run string, after long")
    for n, rows in enumerate(batches):  # each batch is read by a query of its own
        write(spark, rows, folder, n, FRAMES)
        stream = spark.readStream.schema(FRAMES).parquet(f"{folder}/*")
        run(delivery.observed(stream, cursors, on_gap="mark"), str(tmp_path / "check"), lambda df, _: out.extend(map(tuple, df.collect())))
    events = sorted((r, c, e) for r, c, e, _ in out)
    assert events == [("a", 0, "frame"), ("a", 1, "frame"), ("a", 2, "frame"), ("a", 3, "closing"), ("b", 3, "frame"), ("b", 4, "closing"), ("c", 0, "closing"), ("d", 0, "gap")]
    assert "again" not in {p for *_, p in out}


def test_observed_of_a_table_equals_the_stream(spark, tmp_path):
    """A table starts no state store: one call a run took longer than the limit at 900,000 runs."""
    rng = random.Random(4)
    rows = [(f"r{run}", at, rng.choice([False, False, None, True]), rng.choice(["x", "y", None]), 1) for run in range(80) for at in range(9) for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 2]))]
    write(spark, rows, str(tmp_path / "in"), 0, FRAMES)
    cursors = spark.createDataFrame([(f"r{run}", rng.choice([None, -1, 0, 1, 4, 9])) for run in range(60)], "run string, after long")
    for known in (None, cursors):
        out = []
        stream = spark.readStream.schema(FRAMES).parquet(str(tmp_path / "in/*"))
        run(delivery.observed(stream, known, on_gap="mark"), str(tmp_path / f"check{known is None}"), lambda df, _: out.extend(map(tuple, df.collect())))
        table = delivery.observed(spark.read.schema(FRAMES).parquet(str(tmp_path / "in/*")), known, on_gap="mark")
        assert "InPandas" not in table._jdf.queryExecution().toString()
        got = [tuple(r) for r in table.collect()]
        assert sorted(got, key=str) == sorted(out, key=str) and {"gap", "closing", "frame"} == {r[2] for r in got}
    with pytest.raises(Exception, match="expected frame"):
        delivery.observed(spark.read.schema(FRAMES).parquet(str(tmp_path / "in/*"))).count()


def test_a_gap_fails_the_query(spark, tmp_path):
    write(spark, [("a", 0, False, "x", 1), ("a", 2, False, "y", 1)], str(tmp_path / "in"), 0, FRAMES)
    stream = spark.readStream.schema(FRAMES).parquet(str(tmp_path / "in/*"))
    with pytest.raises(Exception, match="expected frame 1, found 2"):
        run(delivery.observed(stream), str(tmp_path / "check"), lambda df, _: df.collect())
    with pytest.raises(ValueError):
        delivery.observed(stream, after=-2)


def test_replay_gaps(spark):
    frames = spark.createDataFrame([("a", 2), ("a", 3), ("b", 0)], "run string, cursor long")
    cursors = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("a", 4), ("b", None), ("c", None), ("c", 0)], "run string, after long")
    assert sorted(map(tuple, log.replay_gaps(frames, cursors).collect())) == [("a", 0, 2, 3), ("a", 4, 2, 3), ("c", 0, 0, -1)]


@pytest.mark.parametrize("range_rows", [100_000, 7])
def test_appends_are_dense_and_replays_add_nothing(spark, tmp_path, monkeypatch, range_rows):
    monkeypatch.setattr(delivery, "RANGE_ROWS", range_rows)
    rng, root = random.Random(2), "file://" + str(tmp_path / "log")
    handle = delivery.append_to(root, "s", ["o"])
    heads = spark.createDataFrame([], "s string, head long")
    want = []
    for b in range(3):
        rows = [(rng.choice("aaab"), b * 100 + i, 1.0) for i in range(20)] + [(None, 1, 1.0)] + ([("new", b, 0.5)] if b == 2 else [])
        batch = spark.createDataFrame(rows, "s string, o int, v double")
        handle(batch, b)
        if b == 1:
            handle(batch, b)  # run again after a loss
        one = log.appended(batch.filter("s is not null"), heads, "s", ["o"]).collect()
        want += [(r.s, r.o, r.position) for r in one]
        heads = spark.createDataFrame([(s, max(p for t, _, p in want if t == s)) for s in {t for t, *_ in want}], "s string, head long")
    got = [(r.s, r.o, r.position) for r in delivery.appended_log(spark, root).collect()]
    assert sorted(got) == sorted(want)
    handle(spark.createDataFrame([], "s string, o int, v double"), 3)
    assert delivery.appended_log(spark, root).count() == len(want)
