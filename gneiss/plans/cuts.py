"""Paths, cuts and groups of the module graph that grows with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, kernels, paths, structure
from .repository import EDGE, LEVELS, module_graph

DIST = f"{EDGE}, hd as (select src as s, dst as t, 1 as h from ed union select hd.s, ed.dst, h + 1 from hd join ed on ed.src = hd.t where h < 60 and hd.s <> ed.dst), di as (select s, t, min(h) as h from hd group by 1, 2)"
WAYS = f"""{DIST}, pt as (select src as s, dst as t, 1 as h, [src, dst] as p from ed union all select pt.s, ed.dst, pt.h + 1, list_append(p, ed.dst) from pt join ed on ed.src = pt.t join di on di.s = pt.s and di.t = ed.dst and di.h = pt.h + 1),
sg as (select s, t, count(*) as n from pt group by 1, 2)"""
EDGEB = f"{WAYS}, eb as (select p[i] as src, p[i + 1] as dst, sum(1 / n) as b from (select p, n, unnest(range(1, len(p))) as i from pt join sg on sg.s = pt.s and sg.t = pt.t) group by 1, 2)"
UNDIRECTED = "un as (select src, dst from ed union select dst, src from ed)"
CUTS = f"""{EDGE}, {UNDIRECTED}, cl as (select src, dst from ed union select cl.src, ed.dst from cl join ed on ed.src = cl.dst),
st as (select e.src as es, e.dst as et, e.src as a from ed e union select e.src, e.dst, cl.src from ed e join cl on cl.dst = e.src),
wo as (select es, et, a, a as x from st union select es, et, a, ed.dst from wo join ed on ed.src = x and not (ed.src = es and ed.dst = et)),
lo as (select st.es, st.et, count(*) as n from st join cl on cl.src = st.a and cl.dst <> st.a left join wo on wo.es = st.es and wo.et = st.et and wo.a = st.a and wo.x = cl.dst where wo.x is null group by 1, 2),
hp as (select e.src as es, e.dst as et, f.dst as hop, f.dst as x from ed e join ed f on f.src = e.src and f.dst <> e.dst union select es, et, hop, ed.dst from hp join ed on ed.src = x and not (ed.src = es and ed.dst = et)),
ro as (select es, et, count(distinct hop) as n from hp where x = et group by 1, 2),
ub as (select src as es, dst as et, src as x, src as o from ed union select src, dst, dst, dst from ed union select es, et, un.dst, o from ub join un on un.src = x where not (un.src = es and un.dst = et and not exists (select 1 from ed r where r.src = et and r.dst = es)) and not (un.src = et and un.dst = es and not exists (select 1 from ed r where r.src = et and r.dst = es))),
sd as (select es, et, count(*) filter (o = es) as a, count(*) filter (o = et) as b, count(*) filter (o = es and x = et) as joined from ub group by 1, 2),
es_ as (select ed.src, ed.dst, coalesce(ro.n, 0) as routes, case when coalesce(ro.n, 0) > 0 then 0 else coalesce(lo.n, 1) - 1 end as severed, sd.joined = 0 as bridge, case when sd.joined = 0 then a else 0 end as src_side, case when sd.joined = 0 then b else 0 end as dst_side
  from ed join sd on sd.es = ed.src and sd.et = ed.dst left join ro on ro.es = ed.src and ro.et = ed.dst left join lo on lo.es = ed.src and lo.et = ed.dst)"""


def betweenness(spark, d):
    nodes, edges = module_graph(spark, d)
    return paths.betweenness(nodes, edges)[0].filter("betweenness > 0").withColumn("betweenness", F.round("betweenness", 12))


def edge_betweenness(spark, d):
    nodes, edges = module_graph(spark, d)
    return paths.betweenness(nodes, edges)[1].withColumn("betweenness", F.round("betweenness", 12))


def articulation(spark, d):
    return paths.articulation_points(*module_graph(spark, d))


def corridors(spark, d):
    return paths.corridors(module_graph(spark, d)[1])[0]


def edge_structure(spark, d):
    return paths.edge_structure(*module_graph(spark, d))


def seams(spark, d):
    nodes, edges = module_graph(spark, d)
    return structure.seams(paths.edge_structure(nodes, edges), paths.betweenness(nodes, edges)[1]).withColumn("betweenness", F.round("betweenness", 12))


def chains(spark, d):
    nodes, edges = module_graph(spark, d)
    parts = graph.cut(graph.strong_components(nodes, edges))
    return paths.longest_chains(parts, edges, 8)


def modularity(spark, d):
    _, edges = module_graph(spark, d)
    rows = edges.select((F.col("src") % 5).alias("package"), "src", "dst", kernels.affinity(F.lit(1), (F.col("src") + F.col("dst")) % 4).alias("weight")).filter("src % 5 = dst % 5")
    return kernels.modularity_groups(rows, "package")


QUERIES = {
    "betweenness": (betweenness, f"with recursive {WAYS}, b as (select unnest(p[2:-2]) as id, 1 / n as x from pt join sg on sg.s = pt.s and sg.t = pt.t) select id, round(sum(x) / (((select count(*) from part) - 1) * ((select count(*) from part) - 2)), 12) as betweenness from b group by 1"),
    "edge_betweenness": (edge_betweenness, f"with recursive {EDGEB} select src, dst, round(b / ((select count(*) from part) * ((select count(*) from part) - 1)), 12) as betweenness from eb"),
    "articulation": (articulation, f"with recursive {EDGE}, {UNDIRECTED}, rr as (select src as o, dst as a, dst as x from un union select o, a, un.dst from rr join un on un.src = x and un.dst <> o) select distinct n.src as id from un n join un m on m.src = n.src and m.dst <> n.dst left join rr on rr.o = n.src and rr.a = n.dst and rr.x = m.dst where rr.x is null"),
    "corridors": (corridors, f"with recursive {WAYS}, k as (select pt.s, pt.t, p from pt join sg on sg.s = pt.s and sg.t = pt.t where n <= 32 and h >= 2), a as (select s, t, p, unnest(range(1, len(p) - 1)) as i from k), r as (select distinct s, t, p[i:i + n - 1] as run from (select *, unnest(range(3, len(p) - i + 2)) as n from a)), c as (select run, count(*) as support from r group by 1 having count(*) >= 2), z as (select run[:-2] as run from c union select run[2:] from c) select array_to_string(c.run, '→') as corridor, len(c.run) - 1 as length, support from c where run not in (select run from z)"),
    "edge_structure": (edge_structure, f"with recursive {CUTS} select * from es_"),
    "seams": (seams, f"with recursive {CUTS}, {EDGEB[len(EDGE) + 2 :]} select es_.*, round(b / ((select count(*) from part) * ((select count(*) from part) - 1)), 12) as betweenness from es_ join eb on eb.src = es_.src and eb.dst = es_.dst where severed >= 1 or (bridge and least(src_side, dst_side) >= 2)"),
    "chains": (chains, f"with recursive {LEVELS}, up as (select s, max(l) as l from lu group by 1), wy as (select s as st, l as top, l, s as at, [s] as p from up where l > 0 and s not in (select t from gg) union all select st, top, up.l, gg.t, list_append(p, gg.t) from wy join gg on gg.s = wy.at join up on up.s = gg.t and up.l = wy.l - 1), b as (select p, top from wy where l = 0 order by top desc, p limit 8), lb as (select c, case when count(*) > 1 then '[' || string_agg(id, '|' order by id) || ']' else min(id)::varchar end as x from cc group by 1), q as (select p, top, unnest(p) as c, unnest(range(len(p))) as i from b) select string_agg(x, '→' order by i) as chain, any_value(top) + 1 as length from q join lb on lb.c = q.c group by p"),
    "modularity": (modularity, None),
}
