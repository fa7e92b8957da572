"""Graph and backlog operators over the trade between nations, orders of customers, and equal documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backlog, graph
from .tables import lines, table



def _trade(spark, d):
    """(nodes, edges): an edge for each customer nation whose rank among the suppliers of a nation is 1 or 2."""
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    volume = lines(spark, d).join(c, "o_custkey").join(s, "l_suppkey").groupBy("src", "dst").agg(F.sum("l_quantity").alias("q"))
    best = volume.groupBy("src").agg(F.max("q").alias("m"))
    return nodes, volume.join(best, "src").filter(F.col("q") >= 0.93 * F.col("m")).select("src", "dst")


EDGES = """v as (select s_nationkey as src, c_nationkey as dst, sum(l_quantity) as q from lineitem join orders on l_orderkey = o_orderkey
  join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey group by 1, 2),
t as (select src, max(q) as m from v group by 1),
e as (select distinct v.src, v.dst from v join t on t.src = v.src where q >= 0.93 * m and v.src <> v.dst)"""
REACH = f"{EDGES}, w as (select src, dst from e union select w.src, e.dst from w join e on w.dst = e.src), r as (select * from w where src <> dst)"


def degree_roles(spark, d):
    return graph.degrees(*_trade(spark, d))


def density(spark, d):
    return graph.density(*_trade(spark, d)).withColumn("density", F.round("density", 9))


def closure_reach(spark, d):
    nodes, edges = _trade(spark, d)
    return graph.reach_counts(nodes, graph.closure(edges)).withColumn("reach_share", F.round("reach_share", 9))


def hop_distance(spark, d):
    return graph.closure(_trade(spark, d)[1], distance=True)


def scc(spark, d):
    nodes, edges = _trade(spark, d)
    return graph.strong_components(nodes, edges)


def layers(spark, d):
    nodes, edges = _trade(spark, d)
    return graph.layers(graph.strong_components(nodes, edges), edges)


def _equal_documents(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"))
    first = docs.groupBy("h").agg(F.min("id").alias("dst"))
    return docs.select("id"), docs.join(first, "h").select(F.col("id").alias("src"), "dst")


def weak_components(spark, d):
    return graph.weak_components(*_equal_documents(spark, d))


def weak_components_trade(spark, d):
    return graph.weak_components(*_trade(spark, d))


def owner_edges(spark, d):
    nodes, edges = _trade(spark, d)
    owners = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("owner"))
    return graph.owner_edges(edges, owners)


def would_cycle(spark, d):
    nodes, edges = _trade(spark, d)
    proposed = nodes.select(F.col("id").alias("src"), ((F.col("id") * 7) % 25).cast("int").alias("dst"))
    return graph.would_cycle(edges, proposed)


def _tasks(spark, d):
    """Task = order, settled F, active P; it depends on the customer's order before, its parent is the first one."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderstatus").alias("status"))
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("id")
    rows = o.withColumns({"before": F.lag("id").over(w), "parent_id": F.when(F.col("id") % 4 == 0, F.lag("id", 2).over(w))})
    return rows.select("id", "status", "parent_id"), rows.filter("before is not null and id % 2 = 0").select(F.col("id").alias("task_id"), F.col("before").alias("depends_on_id"))


TASKS = """o as (select o_orderkey as id, o_orderstatus as status, lag(o_orderkey) over w as before, case when o_orderkey % 4 = 0 then lag(o_orderkey, 2) over w end as parent
  from orders window w as (partition by o_custkey order by o_orderkey)),
b as (select o.id, count(p.id) as n from o join o p on p.id = o.before and p.status <> 'F' where o.id % 2 = 0 group by 1),
a as (select o.id, o.parent, case when status = 'F' then 'settled' when status = 'P' then 'active' when coalesce(n, 0) > 0 then 'blocked' else 'ready' end as availability, coalesce(n, 0) as blocked_by
  from o left join b on b.id = o.id)"""


def availability(spark, d):
    out = backlog.availability(*_tasks(spark, d), ["F"], ["P"], parent_gate=True, open_status="O")
    return out.select("id", "availability", F.array_join(F.col("blocked_by").cast("array<string>"), ",").alias("blocked_by"), F.array_join(F.col("waiting_on").cast("array<string>"), ",").alias("waiting_on"))


def ready(spark, d):
    return backlog.ready(*_tasks(spark, d), ["F"], "O")


def expand(spark, d):
    tasks, _ = _tasks(spark, d)
    return backlog.expand(tasks, tasks.filter("parent_id is null and id % 10 = 0"), 2)












QUERIES = {
    "degree_roles": (degree_roles, f"with {EDGES}, i as (select dst as id, count(*) as n from e group by 1), x as (select src as id, count(*) as n from e group by 1) select n_nationkey as id, coalesce(i.n, 0) as fan_in, coalesce(x.n, 0) as fan_out, case when i.n is null and x.n is null then 'isolated' when i.n is null then 'source' when x.n is null then 'sink' else 'inner' end as role from nation left join i on i.id = n_nationkey left join x on x.id = n_nationkey"),
    "density": (density, f"with {EDGES} select (select count(*) from nation) as nodes, (select count(*) from e) as edges, round((select count(*) from e) / ((select count(*) from nation) * ((select count(*) from nation) - 1)), 9) as density"),
    "closure_reach": (closure_reach, f"with recursive {REACH} select n_nationkey as id, (select count(*) from r where src = n_nationkey) as dependencies, (select count(*) from r where dst = n_nationkey) as dependents, round((select count(*) from r where dst = n_nationkey) / ((select count(*) from nation) - 1), 9) as reach_share from nation"),
    "hop_distance": (hop_distance, f"with recursive {EDGES}, h as (select src, dst, 1 as hops from e union select h.src, e.dst, h.hops + 1 from h join e on h.dst = e.src where h.hops < 25) select src, dst, min(hops)::int as hops from h where src <> dst group by 1, 2"),
    "scc": (scc, f"with recursive {REACH}, m as (select a.src as id, min(a.dst) as low, count(*) as n from r a join r b on a.src = b.dst and a.dst = b.src group by 1) select n_nationkey as id, least(n_nationkey, coalesce(low, n_nationkey)) as component, coalesce(n, 0) + 1 as size from nation left join m on m.id = n_nationkey"),
    "layers": (layers, f"with recursive {REACH}, m as (select a.src as id, min(a.dst) as low from r a join r b on a.src = b.dst and a.dst = b.src group by 1), c as (select n_nationkey as id, least(n_nationkey, coalesce(low, n_nationkey)) as component from nation left join m on m.id = n_nationkey), g as (select distinct a.component as s, b.component as t from e join c a on a.id = e.src join c b on b.id = e.dst where a.component <> b.component), l as (select component as s, 0 as layer from c union select g.s, l.layer + 1 from g join l on g.t = l.s) select c.id, c.component, max(l.layer)::int as layer from c join l on l.s = c.component group by 1, 2"),
    "weak_components": (weak_components, "select doc_id as id, min(doc_id) over (partition by md5(text)) as component from documents"),
    "weak_components_trade": (weak_components_trade, f"with recursive {EDGES}, u as (select src, dst from e union select dst, src from e), w as (select n_nationkey as id, n_nationkey as c from nation union select w.id, u.dst from w join u on u.src = w.c) select id, min(c) as component from w group by 1"),
    "owner_edges": (owner_edges, f"with {EDGES} select a.n_regionkey as \"from\", b.n_regionkey as \"to\", count(*) as edges from e join nation a on a.n_nationkey = src join nation b on b.n_nationkey = dst where a.n_regionkey <> b.n_regionkey group by 1, 2"),
    "would_cycle": (would_cycle, f"with recursive {REACH}, p as (select n_nationkey as src, (n_nationkey * 7) % 25 as dst from nation) select p.src, p.dst from p where src = dst or exists (select 1 from r where r.src = p.dst and r.dst = p.src)"),
    "availability": (availability, f"with recursive {TASKS}, n as (select id, parent as up from o where parent is not null union select n.id, o.parent from n join o on o.id = n.up where o.parent is not null), w as (select n.id, string_agg(distinct up, ',' order by up) as w from n join o on o.id = n.up and o.status = 'O' and n.id <> n.up group by 1), s as (select a.id, a.availability as av, case when a.blocked_by > 0 then (select before from o where o.id = a.id)::varchar end as b, w from a left join w on w.id = a.id), t as (select id, case when av in ('settled', 'active') then av when b is not null or w is not null then 'blocked' else 'ready' end as availability, b, w from s) select id, availability, case when availability = 'blocked' then coalesce(b, '') else '' end as blocked_by, case when availability = 'blocked' then coalesce(w, '') else '' end as waiting_on from t"),
    "ready": (ready, f"with recursive {TASKS}, h as (select o.id, p.id as up from o join o p on p.id = o.parent union select h.id, p.id from h join o on o.id = h.up join o p on p.id = o.parent), q as (select h.id from h join o on o.id = h.up where o.status = 'O' and h.id <> h.up) select a.id from a join o on o.id = a.id where o.status = 'O' and blocked_by = 0 and a.id not in (select id from q)"),
    "expand": (expand, f"with {TASKS}, r as (select id as root, id, 0 as level from o where parent is null and id % 10 = 0), s as (select root, o.id, 1 as level from o join r on o.parent = r.id) select * from r union all select * from s union all select root, o.id, 2 from o join s on o.parent = s.id"),
}
