"""Structure operators over suppliers, customers, parts, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import graph, structure
from ..operators.deal import deal
from .graphs import EDGES, REACH, TASKS, _tasks, _trade
from .tables import count, lines, table


def _refs(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    n = count(spark, d, "lineitem")
    return deal(lines(spark, d), n, "o_custkey").join(deal(customer, n, "o_custkey"), "o_custkey").join(supplier, "l_suppkey")


def boundary_interactions(spark, d):
    out = structure.boundary(_refs(spark, d), "c_nationkey", "s_nationkey", "o_custkey", "l_partkey", count(spark, d, "lineitem"))
    return out.withColumns({c: F.round(c, 9) for c in ("site_share", "symbol_share")})


def through_paths(spark, d):
    return structure.through_paths(_trade(spark, d)[1])


def prefix_owner(spark, d):
    paths = table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    roots = paths.select(scalar.folder_of(F.col("path")).alias("root")).filter("root <> ''").distinct().withColumn("owner", F.upper("root"))
    return structure.longest_prefix_owner(paths, roots).withColumn("owner", F.coalesce("owner", F.lit("-")))


def foundation_groups(spark, d):
    _, edges = _trade(spark, d)
    reach = graph.closure(edges, distance=True)
    uses = graph.simple(edges).withColumn("uses", (F.col("src") + F.col("dst")) % 5)
    return structure.foundations(reach, uses)[1]


def foundation_weights(spark, d):
    _, edges = _trade(spark, d)
    reach = graph.closure(edges, distance=True)
    uses = graph.simple(edges).withColumn("uses", (F.col("src") + F.col("dst")) % 5)
    return structure.foundations(reach, uses)[0].withColumn("weight", F.round("weight", 9))


def fan_cutoffs(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") > 10, F.col("p_size")).otherwise(0).alias("fan"))
    return structure.fan_cutoffs(rows, "p_brand", "fan")




def connected_subgraph(spark, d):
    nodes, edges = _trade(spark, d)
    return structure.subgraph(nodes.join(table(spark, d, "nation").filter("n_regionkey <> 3").select(F.col("n_nationkey").alias("id")), "id"), graph.simple(edges).withColumn("weight", (F.col("src") + F.col("dst")) % 7), 2, True)[1]


def resolved_references(spark, d):
    rows = table(spark, d, "lineitem")
    refs = rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") + F.when(F.col("l_tax") >= 0.07, 10**9).otherwise(0)).alias("artifact"),
        F.expr("case l_linenumber when 1 then l_partkey when 2 then l_partkey + 1 when 3 then -1 end").alias("content"), F.expr("case l_suppkey % 4 when 0 then 'a/../b' when 1 then 'a/b' end").alias("path"),
    )
    p = table(spark, d, "part")
    artifacts = p.select(F.col("p_partkey").alias("artifact"), F.when(F.col("p_size") % 3 > 0, F.col("p_partkey")).alias("current"))
    contents = p.select(F.col("p_partkey").alias("content"), F.col("p_partkey").alias("artifact"), (F.col("p_size") > 10).alias("usable"), F.lit("main").alias("root"), (F.col("p_size") % 2 == 0).alias("entry"))
    entries = p.filter("p_size % 4 > 0").select(F.col("p_partkey").alias("content"), F.lit("main").alias("path"), F.when(F.col("p_size") % 8 < 4, "file").otherwise("directory").alias("type"))
    out = structure.resolve_references(refs, artifacts, contents, entries)
    return out.select("id", "status", F.coalesce("content", F.lit(-9)).alias("content"), F.coalesce("path", F.lit("-")).alias("path"))


def broken_references(spark, d):
    docs = table(spark, d, "documents").filter("n_chars > 1000")
    return structure.broken_references(table(spark, d, "labels").select("doc_id"), "doc_id", docs, "doc_id")


def retention_gaps(spark, d):
    gone = table(spark, d, "events").filter("value < 50")
    return structure.retention_gaps(gone, "event_type", "event_id")


def compaction_floor(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts")).first()[0]
    consumers = spark.createDataFrame([("a", 700, last), ("b", 5, None)], "name string, position long, seen_at timestamp_ntz")
    return structure.compaction_floor(e, consumers, "event_id", "ts", F.lit(last) - F.expr("interval 3 days"), F.lit(last) - F.expr("interval 1 day"))


def context_size(spark, d):
    c = table(spark, d, "conversations").withColumn("usage", F.when((F.col("conv_id") % 2 == 0) & (F.col("turn") % 2 == 1), F.char_length("text").cast("long")))
    return structure.context_size(c, "conv_id", "turn", "usage", scalar.token_estimate(F.col("text")))


def merged_timeline(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("bad").alias("at"), F.col("event_id").cast("string").alias("line"))
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("o_orderkey").cast("string").alias("line"))
    return structure.merged_timeline(("events", e), ("orders", o)).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))






def import_usage(spark, d):
    rows = _refs(spark, d).select(F.col("c_nationkey").alias("package"), F.col("s_nationkey").alias("dependency"), F.col("l_partkey").alias("symbol"), (F.col("l_returnflag") == "R").alias("type_only"))
    return structure.import_usage(rows)




def next_due(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "O", "waiting").otherwise("done").alias("state"), F.when(F.col("o_totalprice") >= 50000, F.col("o_orderdate")).alias("due"), "o_orderkey")
    return structure.next_due(rows, "o_custkey", "state", "due")


def settled_dependencies(spark, d):
    tasks, deps = _tasks(spark, d)
    return structure.broken_references(deps, "depends_on_id", tasks.filter("status <> 'F'").withColumnRenamed("id", "k"), "k").select("task_id", "depends_on_id")


REFS = "lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey"
PAGES = "select distinct regexp_replace(url, '^[a-z]+://', '') as path from pages"
HOPS = f"{EDGES}, h as (select src, dst, 1 as hops from e union select h.src, e.dst, h.hops + 1 from h join e on h.dst = e.src where h.hops < 25), k as (select src, dst, min(hops) as hops from h where src <> dst group by 1, 2), s as (select dst from k group by 1 having count(*) >= 2)"

QUERIES = {
    "boundary_interactions": (boundary_interactions, f"with r as (select c_nationkey, s_nationkey, o_custkey, l_partkey from {REFS}), w as (select c_nationkey, s_nationkey, count(distinct o_custkey) as sites, count(*) as n, count(distinct l_partkey) as symbols from r group by 1, 2), a as (select c_nationkey, s_nationkey, max(n) as m from (select c_nationkey, s_nationkey, o_custkey, count(*) as n from r group by 1, 2, 3) group by 1, 2), b as (select c_nationkey, s_nationkey, max(n) as m from (select c_nationkey, s_nationkey, l_partkey, count(*) as n from r group by 1, 2, 3) group by 1, 2) select w.c_nationkey, w.s_nationkey, sites, n as \"references\", symbols, round(a.m / n, 9) as site_share, round(b.m / n, 9) as symbol_share from w join a using (c_nationkey, s_nationkey) join b using (c_nationkey, s_nationkey)"),
    "through_paths": (through_paths, f"with {EDGES} select a.dst as id, count(*) filter (a.src <> b.dst) as paths from e a join e b on a.dst = b.src group by 1"),
    "prefix_owner": (prefix_owner, f"with p as ({PAGES}), r as (select distinct regexp_replace(path, '/?[^/]*$', '') as root from p), m as (select path, root from p join r on root <> '' and (path = root or starts_with(path, root || '/'))) select p.path, coalesce(upper(arg_max(root, length(root))), '-') as owner from p left join m on m.path = p.path group by 1"),
    "foundation_groups": (foundation_groups, f"with recursive {HOPS}, g as (select k.dst, list_sort(list(src)) as c from k join s on s.dst = k.dst group by 1) select min(dst) as foundation, len(c) as consumers, count(*) as dependencies from g group by c"),
    "foundation_weights": (foundation_weights, f"with recursive {HOPS} select k.dst, k.src, round(0.5::double ** (hops - 1) * (1 + least(0.25::double, 1 - exp(-(case when e.src is null then 0 else (k.src + k.dst) % 5 end) / 4.0::double))), 9) as weight from k join s on s.dst = k.dst left join e on e.src = k.src and e.dst = k.dst"),
    "fan_cutoffs": (fan_cutoffs, "select p_brand, greatest(3, quantile_disc(p_size, 0.9) filter (p_size > 10))::double as cutoff from part group by 1"),
    "connected_subgraph": (connected_subgraph, f"with {EDGES} select src, dst, (src + dst) % 7 as weight from e where (src + dst) % 7 >= 2 and src in (select n_nationkey from nation where n_regionkey <> 3) and dst in (select n_nationkey from nation where n_regionkey <> 3)"),
    "resolved_references": (resolved_references, """with r as (select l_orderkey * 10 + l_linenumber as id, l_partkey as a, l_tax >= 0.07 as gone, case l_linenumber when 1 then l_partkey when 2 then l_partkey + 1 when 3 then -1 end as c, case l_suppkey % 4 when 0 then 'a/../b' when 1 then 'a/b' end as pa from lineitem),
x as (select r.*, p.p_size % 3 > 0 and p.p_size > 10 as cur, q.p_partkey as qk, q.p_size as qs, p.p_size as ps from r join part p on p.p_partkey = a left join part q on q.p_partkey = c),
y as (select *, case when c is not null then qs when cur then ps end as s, case when c is not null then qk when cur then a end as content from x),
z as (select *, coalesce(pa, case when content is not null then 'main' end) as path, case when gone then 'artifact-missing' when c is not null and qk is null then 'content-missing' when c is not null and qk <> a then 'content-mismatch' when c is not null and qs <= 10 then 'content-unusable' when pa = 'a/../b' then 'path-invalid'
  when pa is null and content is not null and s % 2 = 0 and not (s % 4 > 0 and s % 8 < 4) then 'entry-missing' else 'available' end as status from y)
select id, status, case when status = 'available' then coalesce(content, -9) else -9 end as content, case when status = 'available' then coalesce(path, '-') else '-' end as path from z"""),
    "broken_references": (broken_references, "select doc_id from labels where doc_id not in (select doc_id from documents where n_chars > 1000)"),
    "retention_gaps": (retention_gaps, "select event_type, count(*) as removed, max(event_id) as through from events where value < 50 group by 1"),
    "compaction_floor": (compaction_floor, "select least(700, coalesce(min(event_id) filter (ts >= (select max(ts) from events) - interval 3 days) - 1, max(event_id))) as floor from events"),
    "context_size": (context_size, "select conv_id, case when conv_id % 2 = 0 and count(*) filter (turn % 2 = 1) > 0 then arg_max(length(text), turn) filter (turn % 2 = 1) else sum(ceil(length(text) / 4)::bigint + 4) end::bigint as tokens from conversations group by 1"),
    "merged_timeline": (merged_timeline, "select case when event_id % 7 <> 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') else '1970-01-01 00:00:00' end as at, 'events' as source, event_id::varchar as line from events union all select strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'orders', o_orderkey::varchar from orders"),
    "import_usage": (import_usage, f"with r as (select c_nationkey as package, s_nationkey as dependency, l_partkey, bool_and(l_returnflag = 'R') as t from {REFS} group by 1, 2, 3) select package, dependency, count(*) filter (not t) as runtime, count(*) filter (t) as type_only from r group by 1, 2"),
    "next_due": (next_due, "select o_custkey, case when o_totalprice >= 50000 then o_orderdate end as due, o_orderkey from orders where o_orderstatus = 'O' qualify row_number() over (partition by o_custkey order by case when o_totalprice >= 50000 then o_orderdate end nulls last, o_orderkey) = 1"),
    "settled_dependencies": (settled_dependencies, f"with {TASKS} select o.id as task_id, o.before as depends_on_id from o join o p on p.id = o.before where o.id % 2 = 0 and p.status = 'F'"),
}
