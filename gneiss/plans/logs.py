"""Log, conversation and stream operators over events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..operators import log
from ..sources import git
from ..streaming import delivery
from .tables import table


def _events(spark, d):
    return table(spark, d, "events")


def log_read(spark, d):
    return log.read_after(_events(spark, d).select("event_id", "event_type", "user_id"), "event_id", 100, None, "event_type", 100)


def log_offsets(spark, d):
    kinds = [r[0] for r in _events(spark, d).select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("position", T.LongType()), T.StructField("types", T.ArrayType(T.StringType()))])
    consumers = spark.createDataFrame([("all", 10, None), ("some", 500, kinds), ("ahead", 10**9, None)], schema)
    return log.catch_up(_events(spark, d), consumers, "event_id", "event_type")


def log_gap(spark, d):
    rows = _events(spark, d).filter("event_id % 50 <> 7").select((F.col("event_id") % 5).alias("run"), F.floor(F.col("event_id") / 5).cast("long").alias("cursor"))
    return log.gaps(rows, ["run"], "cursor")


def gap_check(spark, d):
    return log.gaps(table(spark, d, "conversations").filter("turn <> 2"), ["conv_id"], "turn")


def retry_schedule(spark, d):
    rows = _events(spark, d).select("event_id", (F.col("event_id") % 12 + 1).alias("failures"), "ts")
    out = log.retry_schedule(rows, "failures", "ts")
    return out.select("event_id", "delay_ms", (F.unix_millis("retry_at") - F.unix_millis(F.col("ts").cast("timestamp"))).alias("wait_ms"))


def retention(spark, d):
    e = _events(spark, d).select("event_id", "ts")
    cutoff = e.agg(F.max("ts").alias("m")).first()[0]
    return log.retention(e, "event_id", "ts", F.lit(cutoff) - F.expr("interval 7 days"), 400).select("event_id")


def _states(spark, d):
    """Events as states of a user's run: a null status is one that is gone."""
    names = F.expr("element_at(array('queued', 'running', 'suspended', 'complete', 'failed', 'cancelled'), cast(event_id * 7 % 6 + 1 as int))")
    return _events(spark, d).select("user_id", "event_id", F.when(F.col("event_id") % 11 != 0, names).alias("status"), (F.col("event_id") % 3).alias("output"), F.floor("value").cast("long").alias("timestamps"), F.create_map(F.lit("stream"), F.col("event_id"), F.lit("note"), F.col("event_id") % 4).alias("metadata"))


def change_events(spark, d):
    return log.change_events(_states(spark, d), "user_id", "event_id", "status", ["output", "timestamps", "metadata"], "timestamps", "metadata")


def velocity(spark, d):
    out = log.velocity(_events(spark, d).select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value")
    return out.select("event_id", F.round(F.coalesce("delta", F.lit(0.0)), 6).alias("delta"))


def rate_limit(spark, d):
    return log.trailing_count(_events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", 86400).select("event_id", "recent")


def budget_cut(spark, d):
    return log.budget_cut(table(spark, d, "conversations").withColumn("asks", F.expr("(conv_id + turn) % 9 = 0")), "conv_id", "turn", "role", scalar.token_estimate(F.col("text")), 120, "asks")


def message_tallies(spark, d):
    return log.message_tallies(table(spark, d, "conversations"), "conv_id", "role", "user")


def claimed_once(spark, d):
    return log.claimed_once(_events(spark, d).select("user_id", "event_id", "event_type"), "user_id", ["event_id"])


def windowed_counts(spark, d):
    e = _events(spark, d).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n")


def _frames(spark, d):
    """Lines as frames of their order; the last line of some orders ends them."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), (F.col("l_linenumber") - 1).alias("cursor"), ((F.col("l_linenumber") > 3) & (F.col("l_returnflag") == "R")).alias("terminal"), F.col("l_partkey").cast("string").alias("payload"))


def replay_gaps(spark, d):
    cursors = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_custkey") % 9 != 8, F.col("o_custkey") % 9 - 1).alias("after"))
    frames = _frames(spark, d).withColumn("cursor", F.col("cursor") + F.col("run") % 2)
    return log.replay_gaps(frames, cursors)


def observed_frames(spark, d):
    """Frames of every order behind its cursor up to the one that ends it; the stateful operator of the stream, run over a table."""
    cursors = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 4 - 1).alias("after"))
    frames = _frames(spark, d).withColumn("cursor", F.when((F.col("run") % 5 == 0) & (F.col("cursor") > 2), F.col("cursor") + 1).otherwise(F.col("cursor")))
    out = delivery.observed(frames, cursors, on_gap="mark")
    return out.select("run", "cursor", "event", F.when(F.col("event") != "gap", F.col("payload")).otherwise("").alias("payload"))


def scanned_changes(spark, d):
    """Orders as commits, their lines as changed files: written in git's format, then parsed."""
    nul, tab = F.lit("\0"), F.lit("\t")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), "l_returnflag")
    binary = F.col("l_returnflag") == "A"
    counts = F.concat(F.when(binary, "-").otherwise(F.col("q").cast("string")), tab, F.when(binary, "-").otherwise((F.col("q") % 7).cast("string")), tab)
    name = F.concat(F.lit("s"), "l_suppkey", F.lit(" d\t=> /p"), "l_partkey", F.lit(".ts"))
    entry = F.when(F.col("l_partkey") % 3 == 0, F.concat(counts, nul, F.lit("5\t5\told"), "l_linenumber", nul, name)).otherwise(F.concat(counts, name))
    files = rows.groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(entry, nul)), "").alias("files"))
    orders = table(spark, d, "orders").join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    value = F.concat(F.concat(F.lit("h"), "o_orderkey"), nul, F.date_format("o_orderdate", "yyyy-MM-dd"), nul, F.concat(F.lit("a"), "o_custkey"), nul, F.lit("\n"), F.coalesce("files", F.lit("")))
    out = git.changes(git.parsed(orders.select(value.alias("value"), F.col("o_orderkey").alias("place"))))
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("additions", "deletions")}).withColumn("previous_path", F.coalesce("previous_path", F.lit("")))


QUERIES = {
    "scanned_changes": (scanned_changes, "select 'h' || o_orderkey as hash, strftime(o_orderdate, '%Y-%m-%d') as timestamp, 'a' || o_custkey as author, 's' || l_suppkey || ' d' || chr(9) || '=> /p' || l_partkey || '.ts' as path, case when l_partkey % 3 = 0 then '5' || chr(9) || '5' || chr(9) || 'old' || l_linenumber else '' end as previous_path, case when l_returnflag = 'A' then -1 else l_quantity::bigint end as additions, case when l_returnflag = 'A' then -1 else l_quantity::bigint % 7 end as deletions from lineitem join orders on o_orderkey = l_orderkey"),
    "replay_gaps": (replay_gaps, "with h as (select l_orderkey as run, min(l_linenumber - 1 + l_orderkey % 2) as e, max(l_linenumber - 1 + l_orderkey % 2) as l from lineitem group by 1), c as (select o_orderkey as run, case when o_custkey % 9 = 8 then -1 else o_custkey % 9 - 1 end as after from orders) select c.run, after, coalesce(e, 0) as earliest, coalesce(l, -1) as latest from c left join h on h.run = c.run where coalesce(e > after + 1, false) or after > coalesce(l, -1)"),
    "observed_frames": (observed_frames, """with f as (select l_orderkey as run, l_linenumber - 1 + (l_orderkey % 5 = 0 and l_linenumber > 3)::int as cursor, l_linenumber > 3 and l_returnflag = 'R' as terminal, l_partkey::varchar as payload, o_custkey % 4 - 1 as after from lineitem join orders on o_orderkey = l_orderkey qualify row_number() over (partition by run, cursor order by terminal, payload) = 1),
b as (select *, row_number() over w + after as due, coalesce(max(terminal::int) over (partition by run order by cursor rows between unbounded preceding and 1 preceding), 0) as over_ from f where cursor > after window w as (partition by run order by cursor)),
g as (select run, min(due) as cursor from b where cursor > due and over_ = 0 group by 1)
select b.run::varchar as run, b.cursor, case when terminal then 'closing' else 'frame' end as event, payload from b left join g on g.run = b.run where over_ = 0 and (g.cursor is null or b.cursor < g.cursor) union all select run::varchar, cursor, 'gap', '' from g"""),
    "log_read": (log_read, "select event_id, event_type, user_id from events where event_id > 100 order by event_id limit 100"),
    "log_offsets": (log_offsets, "with h as (select max(event_id) as head from events), k as (select distinct event_type as t from events order by 1 limit 2) select 'all' as name, (select count(*) from events where event_id > 10) as delivered, head as position from h union all select 'some', (select count(*) from events where event_id > 500 and event_type in (select t from k)), greatest(head, 500) from h union all select 'ahead', 0, 1000000000 from h"),
    "log_gap": (log_gap, "with r as (select event_id % 5 as run, event_id // 5 as cursor from events where event_id % 50 <> 7), x as (select *, coalesce(lag(cursor) over (partition by run order by cursor) + 1, 0) as expected from r) select run, expected, cursor as found from x where expected <> cursor"),
    "gap_check": (gap_check, "with x as (select conv_id, turn, coalesce(lag(turn) over (partition by conv_id order by turn) + 1, 0) as expected from conversations where turn <> 2) select conv_id, expected, turn as found from x where expected <> turn"),
    "retry_schedule": (retry_schedule, "select event_id, least(2 ** (event_id % 12) * 1000, 300000)::bigint as delay_ms, least(2 ** (event_id % 12) * 1000, 300000)::bigint as wait_ms from events"),
    "retention": (retention, "with c as (select max(ts) - interval 7 days as c from events), y as (select min(event_id) as y from events, c where ts >= c) select event_id from events, y where event_id <= 400 and (y is null or event_id < y)"),
    "change_events": (change_events, """with s as (select user_id, event_id, case when event_id % 11 <> 0 then ['queued', 'running', 'suspended', 'complete', 'failed', 'cancelled'][(event_id * 7 % 6 + 1)::int] end as st, event_id % 3 as o, floor(value)::bigint as t, event_id % 4 as m from events),
x as (select *, lag(m) over w as pm, lag(st) over w as b, lag(o) over w as po, lag(t) over w as pt from s window w as (partition by user_id order by event_id)),
c as (select *, array_to_string(list_filter([case when m <> pm then 'metadata' end, case when o <> po then 'output' end, case when t <> pt and st = b then 'timestamps' end], lambda y: y is not null), ',') as ch from x)
select user_id, event_id, 'queued' as event, '' as changed from c where b is null and st is not null union all select user_id, event_id, 'removed', '' from c where b is not null and st is null
union all select user_id, event_id, case st when 'queued' then 'resumed' when 'running' then 'started' when 'suspended' then 'parked' when 'complete' then 'completed' else st end, '' from c where st <> b union all select user_id, event_id, 'updated', ch from c where st is not null and b is not null and ch <> ''"""),
    "velocity": (velocity, "select event_id, round(coalesce(value - lag(value) over (partition by user_id order by ts, event_id), 0), 6) as delta from events"),
    "rate_limit": (rate_limit, "select event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as recent from events"),
    "budget_cut": (budget_cut, "with t as (select conv_id, turn, role, sum(ceil(length(text) / 4) + 4) over (partition by conv_id order by turn desc rows unbounded preceding) as s from conversations), c as (select conv_id, coalesce(max(turn) filter (s >= 120), min(turn)) as c, min(turn) as f, min(turn) filter ((conv_id + turn) % 9 = 0) as a from t group by 1), u as (select c.conv_id, least(min(turn), any_value(a)) as first_kept, any_value(f) as f from c join t on t.conv_id = c.conv_id and turn >= c and role = 'user' group by 1) select conv_id, first_kept from u where first_kept > f"),
    "message_tallies": (message_tallies, "select conv_id, count(*) as messages, count(*) filter (role = 'user') as counted from conversations group by 1"),
    "claimed_once": (claimed_once, "select user_id, min(event_id) as event_id, arg_min(event_type, event_id) as event_type from events group by 1"),
    "windowed_counts": (windowed_counts, "select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2"),
}
