"""History, pair, rollup and rule operators over orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import history, pairs, rollup, rules
from ..operators.deal import deal
from .tables import count, lines, table

HISTORY = history.History("l_orderkey", "l_partkey", "o_custkey", "o_orderdate", "l_quantity")


def _since():
    return F.expr("timestamp_ntz '1995-01-01'")


def churn_by_subject(spark, d):
    out = history.churn(lines(spark, d), HISTORY, _since(), count(spark, d, "lineitem")).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    out = stats.with_strict_rank(out, "commits", ["p_brand"], "commit_percentile")
    return out.select("l_partkey", "p_brand", "commits", "additions", "authors", F.coalesce("primary_author", F.lit(-1)).alias("primary_author"), F.round("primary_share", 9).alias("primary_share"), "first_changed_at", "last_changed_at", F.round("commit_percentile", 9).alias("commit_percentile"))


CHURN = """
with f as (select l_partkey, l_orderkey, o_custkey, o_orderdate, l_quantity from lineitem join orders on l_orderkey = o_orderkey),
w as (select * from f where o_orderdate >= timestamp '1995-01-01'),
a as (select l_partkey, o_custkey, count(distinct l_orderkey) as n, max(o_orderdate) as d, min(l_orderkey) filter (newest) as e from (select *, o_orderdate = max(o_orderdate) over (partition by l_partkey, o_custkey) as newest from w) group by all),
p as (select l_partkey, o_custkey, n, d, row_number() over (partition by l_partkey order by n desc, d desc, e, o_custkey) as r, sum(n) over (partition by l_partkey) as t, count(*) over (partition by l_partkey) as k from a),
q as (select l_partkey, sum(l_quantity) as additions from w group by all),
s as (select l_partkey, min(o_orderdate) as first_changed_at, max(o_orderdate) as last_changed_at from f group by all),
c as (select s.l_partkey, p_brand, coalesce(p.t, 0)::bigint as commits, coalesce(additions, 0) as additions, coalesce(k, 0) as authors, coalesce(p.o_custkey, -1) as primary_author,
  coalesce(round(p.n / p.t, 9), 0) as primary_share, first_changed_at, last_changed_at
  from s join part on p_partkey = s.l_partkey left join p on p.l_partkey = s.l_partkey and r = 1 left join q on q.l_partkey = s.l_partkey)
select *, round((rank() over (partition by p_brand order by commits) - 1) / count(*) over (partition by p_brand), 9) as commit_percentile from c
"""


def churn_kind_totals(spark, d):
    n = count(spark, d, "lineitem")
    rows = deal(lines(spark, d), n, "l_partkey").join(deal(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), n, "l_partkey"), "l_partkey")
    return history.totals_by_kind(rows, HISTORY, "p_type", n).select(F.coalesce("p_type", F.lit("(all)")).alias("kind"), "commits", "subjects", "additions")


def events_over_subjects(spark, d):
    small = table(spark, d, "part").filter("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    return history.distinct_events_over(lines(spark, d), HISTORY, small)


def distribution_pack(spark, d):
    a = rollup.distributions(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "median": 0.5})
    return a.select("l_returnflag", F.round("total", 2).alias("total"), F.round("average", 4).alias("average"), "max", "p50", "p90", "p95", "min", "median")


def _pairs(spark, d):
    return pairs.cochange(lines(spark, d), "l_orderkey", "l_suppkey", "o_orderdate", rows=count(spark, d, "lineitem"))


def cochange_pairs(spark, d):
    p = pairs.strong(_pairs(spark, d), pairs.Policy(min_support=2, min_conditional=0.02, min_jaccard=0.01))
    return p.select("left", "right", "support", "left_n", "right_n", *[F.round(c, 9).alias(c) for c in ("left_conditional", "right_conditional", "jaccard")], "last_at")


PAIRS = """
b as (select l_orderkey, l_suppkey, max(o_orderdate) as t from lineitem join orders on l_orderkey = o_orderkey group by all),
k as (select * from b where l_orderkey in (select l_orderkey from b group by all having count(*) <= 40)),
n as (select l_suppkey, count(*) as n from k group by all),
s as (select x.l_suppkey as "left", y.l_suppkey as "right", count(*) as support, max(x.t) as last_at from k x join k y on x.l_orderkey = y.l_orderkey and x.l_suppkey < y.l_suppkey group by all),
p as (select s."left", s."right", support, a.n as left_n, b2.n as right_n, support / a.n as left_conditional, support / b2.n as right_conditional,
  support / (a.n + b2.n - support) as jaccard, last_at from s join n a on a.l_suppkey = s."left" join n b2 on b2.l_suppkey = s."right")
"""


def cochange_partner(spark, d):
    ends = 4 * count(spark, d, "lineitem")  # an order has four lines on average: two pairs a line
    return pairs.partners(_pairs(spark, d), ends).withColumn("jaccard", F.round("jaccard", 9))


def _owned(spark, d):
    owner = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return lines(spark, d).join(owner, "l_suppkey")








def monthly_checkpoints(spark, d):
    return history.monthly_checkpoints(table(spark, d, "orders"), "o_orderkey", "o_orderdate")


def spaced_checkpoints(spark, d):
    return history.spaced_checkpoints(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", "o_orderdate", 7).select("pos", "o_orderkey")


def lineage_intervals(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") != "F").alias("alive"))
    return history.lineage_intervals(rows, "o_custkey", "o_orderkey", "alive").withColumn("until", F.coalesce("until", F.lit(-1)))




def _refs(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return lines(spark, d).join(customer, "o_custkey")


def consumer_rollup(spark, d):
    bit = F.when(F.col("l_returnflag") == "R", 2).otherwise(1)
    out = rollup.consumers(_refs(spark, d), "l_suppkey", "c_nationkey", "l_partkey", bit)
    return out.withColumns({c: F.round(c, 9) for c in ("reference_share", "surface_share")})


def primary_consumer(spark, d):
    return rollup.primary_consumer(rollup.consumers(_refs(spark, d), "l_suppkey", "c_nationkey", "l_partkey", F.lit(1)), "l_suppkey", "c_nationkey")


def concentration(spark, d):
    return rollup.concentration(table(spark, d, "lineitem"), "l_suppkey").withColumn("share", F.round("share", 9))


def traffic_pairs(spark, d):
    e = _refs(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return rollup.traffic(e, "c_nationkey", "s_nationkey", "o_custkey", "l_suppkey")


def size_pivot(spark, d):
    kinds = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    owners = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return rollup.size_pivot(table(spark, d, "customer"), owners, "c_nationkey", "c_mktsegment", kinds)


PIVOT = "select n_nationkey as c_nationkey, {}, count(c_custkey) filter (c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')) as total from nation left join customer on c_nationkey = n_nationkey group by n_nationkey".format(
    ", ".join(f"count(*) filter (c_mktsegment = '{k}') as {k}" for k in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
)


def placement(spark, d):
    rows = _refs(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    out = rollup.placement(rows, ["l_suppkey", "s_nationkey"], "s_nationkey", "c_nationkey", 0.05)
    return out.withColumn("top_share", F.round("top_share", 9))


def ownership_leaders(spark, d):
    rows = _refs(spark, d).groupBy("l_suppkey", "l_returnflag", "c_nationkey").agg(F.sum("l_quantity").alias("v")).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return rollup.leaders(rows, "l_suppkey", "l_returnflag", "c_nationkey", "v", "s_nationkey").withColumn("share", F.round("share", 9))


def rank_metrics(spark, d):
    c = history.churn(lines(spark, d), HISTORY, rows=count(spark, d, "lineitem")).select("l_partkey", "commits", "authors", "additions")
    return rollup.rank_metrics(c, "l_partkey", ["commits", "authors", "additions"], 10)


def matrix_cells(spark, d):
    rows = _refs(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return rollup.matrix(rows, "c_nationkey", "s_nationkey", "l_partkey")


def histogram(spark, d):
    return rollup.histogram(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("s")), "s")


def observation_density(spark, d):
    return rollup.observation_density(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


def operating_stats(spark, d):
    """Lines as runs by supplier: open lines are under way, some were never started."""
    status = F.expr("case when l_returnflag = 'R' then 'complete' when l_returnflag = 'A' then 'failed' when l_linestatus = 'F' then 'cancelled' when l_linenumber = 1 then 'queued' when l_linenumber = 2 then 'paused' when l_linenumber = 3 then 'lost' else 'running' end")
    ms = {c: F.unix_millis(F.col(c).cast("timestamp")) for c in ("o_orderdate", "l_shipdate")}
    started = F.when(F.col("l_linenumber") != 1, ms["l_shipdate"] - 3_600_000 * F.col("l_quantity").cast("long"))
    ended = F.when(F.col("l_linestatus") == "F", ms["l_shipdate"])
    runs = lines(spark, d).select("l_suppkey", status.alias("status"), (F.col("l_tax") > 0.07).alias("attention"), ms["o_orderdate"].alias("created_at"), started.alias("started_at"), ended.alias("ended_at"))
    out = rollup.operating_stats(runs, ["l_suppkey"])
    return out.withColumn("success_rate", F.round(F.coalesce("success_rate", F.lit(-1.0)), 9)).na.fill(-1, ["median_run_ms", "median_queue_ms"])


def skyline(spark, d):
    return rules.skyline(table(spark, d, "part"), "p_partkey", "p_retailprice", "p_size")


def pareto_groups(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("price"), F.max("p_size").alias("size"), F.count("*").alias("n"))
    return rules.pareto(g, "p_brand", ["price"], ["size", "n"])


def classified_parts(spark, d):
    big, dear = F.col("p_size") >= 40, F.col("p_retailprice") >= 1500
    return table(spark, d, "part").select(
        "p_partkey", rules.signals({"big": big, "dear": dear, "both": big & dear}).alias("signals"), rules.first_of({"junction": big & dear, "mixed": big | dear}, "commons").alias("role")
    )


LINES = "lineitem join orders on l_orderkey = o_orderkey"
REFS = f"{LINES} join customer on c_custkey = o_custkey"

QUERIES = {
    "churn_by_subject": (churn_by_subject, CHURN),
    "churn_kind_totals": (churn_kind_totals, f"select coalesce(p_type, '(all)') as kind, count(distinct l_orderkey) as commits, count(distinct l_partkey) as subjects, sum(l_quantity) as additions from {LINES} join part on p_partkey = l_partkey group by rollup (p_type)"),
    "events_over_subjects": (events_over_subjects, "select count(distinct l_orderkey) as commits from lineitem where l_partkey in (select p_partkey from part where p_size <= 5)"),
    "distribution_pack": (distribution_pack, "select l_returnflag, round(sum(l_extendedprice), 2) as total, round(avg(l_extendedprice), 4) as average, max(l_extendedprice) as max, quantile_disc(l_extendedprice, 0.5) as p50, quantile_disc(l_extendedprice, 0.9) as p90, quantile_disc(l_extendedprice, 0.95) as p95, min(l_extendedprice) as min, quantile_disc(l_extendedprice, 0.5) as median from lineitem group by 1"),
    "cochange_pairs": (cochange_pairs, f"with {PAIRS} select \"left\", \"right\", support, left_n, right_n, round(left_conditional, 9) as left_conditional, round(right_conditional, 9) as right_conditional, round(jaccard, 9) as jaccard, last_at from p where support >= 2 and (greatest(left_conditional, right_conditional) >= 0.02 or jaccard >= 0.01)"),
    "cochange_partner": (cochange_partner, f"with {PAIRS}, u as (select \"left\" as node, \"right\" as partner, jaccard, left_conditional as c from p union all select \"right\", \"left\", jaccard, right_conditional from p), r as (select *, row_number() over (partition by node order by jaccard desc, c desc, partner) as r, count(*) over (partition by node) as partners from u) select node, partners, partner as strongest, round(jaccard, 9) as jaccard from r where r = 1"),
    "monthly_checkpoints": (monthly_checkpoints, "select strftime(o_orderdate, '%Y-%m') as month, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1"),
    "spaced_checkpoints": (spaced_checkpoints, "with p as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, count(*) over () - 1 as l from orders), w as (select distinct floor(i * l / 6 + 0.5) as x from p, range(7) t(i)) select pos, o_orderkey from p where pos in (select x from w)"),
    "lineage_intervals": (lineage_intervals, "with b as (select o_custkey, o_orderkey, o_orderstatus <> 'F' as alive, lag(o_orderstatus <> 'F') over (partition by o_custkey order by o_orderkey) as b from orders) select o_custkey, o_orderkey as since, coalesce(lead(o_orderkey) over (partition by o_custkey order by o_orderkey), -1) as until, alive from b where b is null or b <> alive"),
    "consumer_rollup": (consumer_rollup, f"with r as (select * from {REFS}), a as (select l_suppkey, count(*) as n, count(distinct l_partkey) as s from r group by 1) select r.l_suppkey, c_nationkey, count(*) as \"references\", count(distinct l_partkey) as symbols, bit_or(case when l_returnflag = 'R' then 2 else 1 end) as namespace, round(count(*) / any_value(a.n), 9) as reference_share, round(count(distinct l_partkey) / any_value(a.s), 9) as surface_share from r join a on a.l_suppkey = r.l_suppkey group by 1, 2"),
    "primary_consumer": (primary_consumer, f"with c as (select l_suppkey, c_nationkey, count(*) as r, count(distinct l_partkey) as s from {REFS} group by 1, 2), k as (select *, row_number() over (partition by l_suppkey order by r desc, s desc, c_nationkey) as i from c) select l_suppkey, c_nationkey as primary_consumer, r as \"references\" from k where i = 1"),
    "concentration": (concentration, "select l_suppkey, count(*) as edges, round(count(*) / sum(count(*)) over (), 9) as share from lineitem group by 1"),
    "traffic_pairs": (traffic_pairs, f"select c_nationkey, s_nationkey, count(distinct o_custkey) as consumers, count(distinct l_suppkey) as suppliers, count(*) as links from {REFS} join supplier on s_suppkey = l_suppkey where c_nationkey <> s_nationkey group by 1, 2"),
    "size_pivot": (size_pivot, PIVOT),
    "placement": (placement, " union all ".join(f"select '{lv}' as level, {lv}::varchar as id, count(*) as consumers, sum(h)::bigint as home, count(*) - sum(h)::bigint as away, sum(n)::bigint as uses, round(max(n) / sum(n), 9) as top_share, max(n) / sum(n) >= 0.05 as dominant from (select {lv}, c_nationkey, count(*) as n, max((s_nationkey = c_nationkey)::int) as h from {REFS} join supplier on s_suppkey = l_suppkey group by 1, 2) group by {lv}" for lv in ("l_suppkey", "s_nationkey"))),
    "ownership_leaders": (ownership_leaders, f"with v as (select l_suppkey, l_returnflag, c_nationkey, sum(l_quantity) as v, any_value(s_nationkey) as h from {REFS} join supplier on s_suppkey = l_suppkey group by 1, 2, 3), r as (select *, row_number() over (partition by l_suppkey, l_returnflag order by v desc, (c_nationkey <> h), c_nationkey) as r, sum(v) over (partition by l_suppkey, l_returnflag) as t from v where v > 0) select l_suppkey, l_returnflag, c_nationkey as leader, round(v / t, 9) as share from r where r = 1"),
    "rank_metrics": (rank_metrics, f"with c as (select l_partkey as id, count(distinct l_orderkey)::double as commits, count(distinct o_custkey)::double as authors, sum(l_quantity)::double as additions from {LINES} group by 1), u as (unpivot c on commits, authors, additions into name metric value value), r as (select *, row_number() over (partition by metric order by value desc, id) as rank, count(*) over (partition by metric) as total from u where value > 0) select metric, id, value, rank, total from r where rank <= 10"),
    "matrix_cells": (matrix_cells, f"select c_nationkey as row, s_nationkey as \"column\", count(distinct l_partkey) as value from {REFS} join supplier on s_suppkey = l_suppkey group by 1, 2"),
    "histogram": (histogram, "select coalesce(case when o_orderstatus <> 'P' then o_orderstatus end, 'null') as value, count(*) as n from orders group by 1"),
    "observation_density": (observation_density, "with s as (select l_partkey, count(distinct l_suppkey) as s from lineitem group by 1) select case when s >= 3 then '3+' else s::varchar end as sources, count(*) as entities from s group by 1"),
    "operating_stats": (operating_stats, f"""with r as (select l_suppkey, case when l_returnflag = 'R' then 'complete' when l_returnflag = 'A' then 'failed' when l_linestatus = 'F' then 'cancelled' when l_linenumber = 1 then 'queued' when l_linenumber = 2 then 'paused' when l_linenumber = 3 then 'lost' else 'running' end as s, l_tax > 0.07 as a, epoch_ms(o_orderdate) as c, case when l_linenumber <> 1 then epoch_ms(l_shipdate) - 3600000 * l_quantity::bigint end as b, case when l_linestatus = 'F' then epoch_ms(l_shipdate) end as e from {LINES}),
k as (select *, case when a or s = 'paused' then 'waiting' else s end as k from r)
select l_suppkey, count(*) filter (k = 'cancelled') as cancelled, count(*) filter (k = 'complete') as complete, count(*) filter (k = 'failed') as failed, count(*) filter (k = 'queued') as queued, count(*) filter (k = 'running') as running, count(*) filter (k = 'waiting') as waiting, count(*) as total,
coalesce(median(e - b), -1)::double as median_run_ms, coalesce(median(greatest(0, b - c)) filter (b is not null), -1)::double as median_queue_ms,
coalesce(round(count(*) filter (k = 'complete') / nullif(count(*) filter (k in ('complete', 'failed')), 0), 9), -1) as success_rate from k group by 1"""),
    "skyline": (skyline, "select p_partkey, p_retailprice, p_size from part a where not exists (select 1 from part b where b.p_retailprice <= a.p_retailprice and b.p_size >= a.p_size and (b.p_retailprice < a.p_retailprice or b.p_size > a.p_size))"),
    "pareto_groups": (pareto_groups, "with g as (select p_brand, min(p_retailprice) as price, max(p_size) as size, count(*) as n from part group by 1) select * from g a where not exists (select 1 from g b where b.price <= a.price and b.size >= a.size and b.n >= a.n and (b.price < a.price or b.size > a.size or b.n > a.n))"),
    "classified_parts": (classified_parts, "select p_partkey, array_to_string(list_filter([case when p_size >= 40 then 'big' end, case when p_retailprice >= 1500 then 'dear' end, case when p_size >= 40 and p_retailprice >= 1500 then 'both' end], lambda x: x is not null), ',') as signals, case when p_size >= 40 and p_retailprice >= 1500 then 'junction' when p_size >= 40 or p_retailprice >= 1500 then 'mixed' else 'commons' end as role from part"),
}
