"""Package topology and responsibility regions over parts as modules, and lines that follow one another in an order as imports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, internal, proximity
from .tables import table

PATH = "concat(case when p_size % 7 = 0 then '' else concat('src/r', p_size % 3, case when p_size % 2 = 0 then concat('/d', p_size % 5) else '' end, '/') end, 'f', p_partkey)"


def _modules(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 9 == 0, "test").otherwise("source")
    return p.select(F.expr("concat('p', p_partkey % 40)").alias("package"), F.expr(PATH).alias("module"), kind.alias("kind"), (F.col("p_size") == 13).alias("aggregator"), F.col("p_partkey").alias("key"), "p_size")


def _steps(spark, d):
    """(src, dst, named, elsewhere, third) of each pair of following lines whose parts lie in one package: which imports which, and how.

    Lines alone in their order and package have no such pair. They go by one count, so that only the few others are joined.
    """
    flags = (F.col("l_tax") > 0).alias("up"), (F.col("l_discount") > 0).alias("named"), (F.col("l_returnflag") == "R").alias("elsewhere")
    rows = table(spark, d, "lineitem").filter("l_orderkey is not null").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("l_partkey % 40").alias("place"), *flags)
    several = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "place")) > 1
    rows = graph.cut(rows.withColumn("_several", several).filter("_several").drop("_several"))
    after = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), "place", F.col("l_partkey").alias("b"))
    pairs = rows.join(after, ["l_orderkey", "l_linenumber", "place"]).filter("l_partkey <> b")
    low, high = F.least("l_partkey", "b"), F.greatest("l_partkey", "b")
    return pairs.select(F.when(F.col("up"), low).otherwise(high).alias("src"), F.when(F.col("up"), high).otherwise(low).alias("dst"), "named", "elsewhere", (F.col("l_linenumber") % 3).alias("third"))


def _imports(spark, d, steps):
    """(package, source, target, symbol, declared) of each of the steps between source modules."""
    e = steps.select("src", "dst", F.when(F.col("named"), F.concat(F.lit("s"), "dst", F.lit("/"), "third")).alias("symbol"), F.when(F.col("elsewhere"), F.col("dst") + 40).alias("decl")).distinct()
    m = _modules(spark, d).filter("kind = 'source'").select("package", "module", "key")
    s, t, v = (m.select(F.col("module").alias(n), F.col("key").alias(k)) for n, k in (("source", "src"), ("target", "dst"), ("declared", "decl")))
    return e.join(s.join(m.select(F.col("key").alias("src"), "package"), "src"), "src").join(t, "dst").join(v, "decl", "left").select("package", "source", "target", "symbol", "declared")


def _topology(spark, d, steps):
    m = _modules(spark, d)
    e = steps.select("src", "dst").distinct()
    e = e.join(m.select(F.col("key").alias("src"), "package", F.col("module").alias("source")), "src").join(m.select(F.col("key").alias("dst"), F.col("module").alias("target")), "dst")
    return internal.topology(m.select("package", "module", "kind", "aggregator"), graph.cut(e.select("package", "source", "target")))


def internal_topology(spark, d):
    """Topology of every package, one row a module."""
    out = _topology(spark, d, _steps(spark, d)).withColumn("roles", F.array_join("roles", ",")).withColumn("cycle", F.coalesce("cycle", F.lit("-")))
    return out.drop("fan_in_cut", "id")


def _regions(spark, d):
    """Topology, imports and regions of responsibility; the steps between lines are joined once for both."""
    steps = graph.cut(_steps(spark, d))
    modules = graph.cut(_topology(spark, d, steps))
    symbols = graph.cut(_imports(spark, d, steps))
    concepts = _modules(spark, d).filter("p_size < 10").select(F.col("key").alias("_k"))
    local = internal.localized_symbols(symbols, modules).withColumn("_k", F.regexp_extract("symbol", "s([0-9]+)/", 1).cast("long"))
    local = local.join(concepts.withColumn("concept", F.lit(True)), "_k", "left").select("package", "symbol", "concept")
    return modules, symbols, internal.responsibilities(modules, symbols, local)


def responsibility_regions(spark, d):
    """Regions of responsibility of every package: topology, symbol locality and staged joins, one row a module."""
    return _regions(spark, d)[2].withColumns({c: F.coalesce(c, F.lit("-")) for c in ("region", "reason")})


def _placed(spark, d):
    """Modules at their regions of responsibility, and the imports and common changes between them."""
    modules, symbols, regions = _regions(spark, d)
    files = proximity.placed(modules.withColumn("root", F.concat(F.lit("packages/"), "package")), regions)
    return modules, symbols, regions, files


def files_apart(spark, d):
    """Modules outside the folder that holds most of their region."""
    return proximity.files_apart(_placed(spark, d)[3])


def close_folders(spark, d):
    """Folders with regions that nothing relates: no import between them, no order with parts of both two lines apart."""
    _, symbols, regions, files = _placed(spark, d)
    at = regions.filter("region is not null").select("package", "module", "region")
    ends = [at.select("package", F.col("module").alias(n), F.col("region").alias(r)) for n, r in (("source", "from"), ("target", "to"))]
    links = symbols.select("package", "source", "target").join(ends[0], ["package", "source"]).join(ends[1], ["package", "target"]).select("package", "from", "to")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = rows.select("l_orderkey", (F.col("l_linenumber") - 2).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    name = _modules(spark, d).select("key", F.concat(F.lit("packages/"), "package", F.lit("/"), "module").alias("file"))
    pairs = rows.join(after, ["l_orderkey", "l_linenumber"]).filter("l_partkey % 40 = b % 40")
    pairs = pairs.join(name.select(F.col("key").alias("l_partkey"), F.col("file").alias("left")), "l_partkey").join(name.select(F.col("key").alias("b"), F.col("file").alias("right")), "b")
    return proximity.close_folders(files, proximity.related(files, links, pairs))


TOPOLOGY = f"""mo as (select p_partkey as id, 'p' || (p_partkey % 40) as package, {PATH} as module, p_size % 9 = 0 as test, p_size = 13 as agg, p_size from part),
fo as (select *, case when module like '%/%' then regexp_replace(module, '/[^/]*$', '') else '.' end as folder from mo),
md as (select *, case when folder = '.' or folder = 'src' then '.' else string_split(folder, '/')[2] end as region from fo),
ln as (select case when a.l_tax > 0 then least(a.l_partkey, b.l_partkey) else greatest(a.l_partkey, b.l_partkey) end as src, case when a.l_tax > 0 then greatest(a.l_partkey, b.l_partkey) else least(a.l_partkey, b.l_partkey) end as dst,
  a.l_discount as disc, a.l_returnflag as flag, a.l_linenumber as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey % 40 = b.l_partkey % 40 and a.l_partkey <> b.l_partkey),
ed as (select distinct src, dst from ln join md s on s.id = src and not s.test join md t on t.id = dst and not t.test),
cx as (select dst as id, count(distinct src) as n from ln join md s on s.id = src and s.test group by 1),
re as (select src, dst from ed union select re.src, ed.dst from re join ed on ed.src = re.dst),
sc as (select a.src as id, min(a.dst) as low from re a join re b on b.src = a.dst and b.dst = a.src group by 1),
co as (select md.id, package, module, least(md.id, coalesce(low, md.id)) as c from md left join sc on sc.id = md.id where not test),
cy as (select package, c, 'cycle-' || row_number() over (partition by package order by count(*) desc, min(module)) as cycle from co group by 1, 2 having count(*) > 1),
dg as (select distinct a.c as s, b.c as t from ed join co a on a.id = src join co b on b.id = dst where a.c <> b.c),
ly as (select c as s, 0 as layer from co union select dg.s, ly.layer + 1 from dg join ly on dg.t = ly.s),
lv as (select s, max(layer) as layer from ly group by 1),
un as (select src, dst from ed union select dst, src from ed),
rr as (select src as o, dst as a, dst as x from un union select o, a, un.dst from rr join un on un.src = x and un.dst <> o),
br as (select distinct n.src as id from un n join un m on m.src = n.src and m.dst <> n.dst left join rr on rr.o = n.src and rr.a = n.dst and rr.x = m.dst where rr.x is null),
fi as (select dst as id, count(*) as n from ed group by 1), fu as (select src as id, count(*) as n from ed group by 1), ne as (select src as id, count(*) as n from un group by 1),
ci as (select package, greatest(3, list_sort(list(n))[ceil(0.9 * count(*))::int]) as k from fi join md using (id) group by 1),
cu as (select package, greatest(3, list_sort(list(n))[ceil(0.9 * count(*))::int]) as k from fu join md using (id) group by 1),
tp as (select md.id, md.package, md.module, folder, region, agg, coalesce(fi.n, 0) as fan_in, coalesce(fu.n, 0) as fan_out, coalesce(cx.n, 0) as context_fan_in, lv.layer::int as layer, cycle, ci.k as ik, ne.n as near, br.id is not null as bridge,
  coalesce(fi.n >= ci.k, false) as hi, coalesce(fu.n >= cu.k, false) as ho
  from md join co on co.id = md.id join lv on lv.s = co.c left join cy on cy.package = md.package and cy.c = co.c left join fi on fi.id = md.id left join fu on fu.id = md.id left join ne on ne.id = md.id left join cx on cx.id = md.id
  left join br on br.id = md.id left join ci on ci.package = md.package left join cu on cu.package = md.package)"""
REGIONS = """sy as (select distinct src, dst, case when disc > 0 then 's' || dst || '/' || n % 3 end as symbol, case when flag = 'R' then dst + 40 end as decl from ln join tp s on s.id = src join tp t on t.id = dst),
us as (select distinct src, symbol from sy where symbol is not null),
sh as (select symbol, region, count(*) as n from us join tp on tp.id = src group by 1, 2),
st as (select symbol, count(*) as consumers, count(distinct folder) as folders, any_value(ik) as ik from us join tp on tp.id = src group by 1),
sp as (select symbol, any_value(consumers) as consumers, any_value(folders) as folders, any_value(ik) as ik, max(n / consumers) as top, count(*) as regions, count(*) filter (n / consumers >= 0.1) as sig from sh join st using (symbol) group by 1),
sd as (select *, top >= 0.6 as dom, top < 0.6 and sig >= 2 as split, consumers = 1 or folders = 1 or regions = 1 as close from sp),
lo as (select symbol, coalesce(p_size < 10, false) as concept from sd join part on p_partkey = regexp_extract(symbol, 's([0-9]+)/', 1)::bigint where (close or dom or split) and not (consumers >= 2 and (close or dom or split) and not dom) and (ik is null or consumers < ik)),
u as (select *, package || ':' || case when cycle is not null then 'cycle:' || cycle else 'module:' || module end as unit, cycle is null as single, agg or hi or ho as conn from tp),
fl as (select distinct a.unit as x, b.unit as y from sy join lo using (symbol) join u a on a.id = src left join u v on v.id = decl join u b on b.id = coalesce(v.id, dst)
  where a.unit <> b.unit and not a.conn and not b.conn and (concept or (a.folder = b.folder and a.folder not in ('.', 'src')))),
tw as (select x, y from fl union select y, x from fl),
wc as (select unit as a, unit as b from u union select wc.a, tw.y from wc join tw on tw.x = wc.b),
gr as (select a as unit, min(b) as grp from wc group by 1),
m1 as (select u.*, gr.grp, exists (select 1 from tw where tw.x = u.unit) as joined from u join gr using (unit)),
bo as (select src, dst, lo.symbol from sy left join lo using (symbol) union select dst, src, lo.symbol from sy left join lo using (symbol)),
nb as (select bo.src as id, bo.dst as to_, count(distinct symbol) as syms from bo group by 1, 2),
nr as (select nb.id, to_, m1.grp as tg, syms from nb join m1 on m1.id = to_ where not single or not conn),
op as (select m1.id, package, grp, row_number() over (partition by package order by module) as k, coalesce((select list({'t': nr.to_, 'g': tg}) from nr where nr.id = m1.id and syms > 0 and tg <> m1.grp), []) as cs from m1 where single and not joined and not conn and bridge),
bs as (select distinct package, 0::bigint as k, []::bigint[] as un from op union all
  select bs.package, op.k, case when len(list_distinct(list_transform(list_filter(op.cs, lambda c: not list_contains(bs.un, c.t)), lambda c: c.g))) >= 2 then list_append(bs.un, op.id) else bs.un end from bs join op on op.package = bs.package and op.k = bs.k + 1),
sk as (select unnest(arg_max(un, k)) as id from bs group by package),
m2 as (select m1.*, sk.id is not null as stuck, single and not joined and not conn and sk.id is null and folder not in ('.', 'src') as rest from m1 left join sk on sk.id = m1.id),
m3 as (select *, case when rest then min(grp) filter (rest) over (partition by package, folder) else grp end as g2 from m2),
cn as (select a.id, count(distinct b.g2) filter (syms > 0) as l, count(distinct b.g2) as n, min(b.g2) filter (syms > 0) as lg, min(b.g2) as ng from m3 a join nr on nr.id = a.id join m3 b on b.id = nr.to_ and not b.stuck where a.single and a.conn group by 1),
m4 as (select m3.*, single and conn as of_, case when l > 0 then l else coalesce(n, 0) end as k, case when l > 0 then lg else ng end as kg from m3 left join cn on cn.id = m3.id),
m5 as (select package, module, case when stuck or (of_ and k > 1) then 'unresolved' when of_ and k = 1 then 'attached' else 'assigned' end as status, case when of_ and k = 1 then kg else g2 end as g,
  case when stuck then 'bridge' when agg then 'aggregator' when hi then 'distributed-primitive' else 'wide-dependent' end as reason from m4),
rg as (select g, 'responsibility:' || left(sha256(string_agg(module, chr(10) order by module)), 12) as region from m5 where status <> 'unresolved' group by 1)"""

PLACED = """fp as (select u.package, u.id, 'packages/' || u.package || '/' || m5.module as file, 'packages/' || u.package || case when folder = '.' then '' else '/' || folder end as folder, case when status <> 'unresolved' then rg.region end as region
  from m5 join u on u.package = m5.package and u.module = m5.module left join rg using (g)),
hm as (select package, region, arg_min(folder, (-n, folder)) as home from (select package, region, folder, count(*) as n from fp where region is not null group by 1, 2, 3) group by 1, 2),
pc as (select fp.*, home from fp left join hm using (package, region))"""
CLOSE = """rl as (select distinct a.package, least(a.region, b.region) as a, greatest(a.region, b.region) as b from (select src, dst from sy union select x.l_partkey, y.l_partkey from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and y.l_linenumber = x.l_linenumber + 2 and x.l_partkey % 40 = y.l_partkey % 40) e
  join pc a on a.id = e.src join pc b on b.id = e.dst where a.region <> b.region),
nd as (select package, folder, region, count(*) as files, count(*) filter (home <> folder) as apart from pc where region is not null group by 1, 2, 3),
lk as (select x.package, x.folder, x.region as s, y.region as t from nd x join nd y on x.package = y.package and x.folder = y.folder join rl on rl.package = x.package and ((rl.a = x.region and rl.b = y.region) or (rl.b = x.region and rl.a = y.region))),
cc as (select package, folder, region as s, region as t from nd union select cc.package, cc.folder, cc.s, lk.t from cc join lk on lk.package = cc.package and lk.folder = cc.folder and lk.s = cc.t),
cg as (select package, folder, s as region, min(t) as g from cc group by 1, 2, 3),
gg as (select package, folder, g, count(*) as regions, sum(files)::bigint as files, sum(apart)::bigint as apart, count(*) over (partition by package, folder) as k from cg join nd using (package, folder, region) group by 1, 2, 3)"""

QUERIES = {
    "files_apart": (files_apart, f"with recursive {TOPOLOGY}, {REGIONS}, {PLACED}, pa as (select *, string_split(folder, '/') as x, string_split(home, '/') as y from pc where home <> folder) select package, file, folder, region, home, len(x) + len(y) - 2 * len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i])) as distance from pa"),
    "close_folders": (close_folders, f'with recursive {TOPOLOGY}, {REGIONS}, {PLACED}, {CLOSE} select package, folder, g as first_region, regions, files, apart, (select count(*) from pc where pc.package = gg.package and pc.folder = gg.folder and region is null) as unresolved from gg where k > 1'),
    "internal_topology": (internal_topology, f"with recursive {TOPOLOGY} select package, module, folder, region, fan_in, fan_out, context_fan_in, layer, coalesce(cycle, '-') as cycle, array_to_string(list_filter([case when near is null then 'isolated' when fan_in = 0 then 'dependency-source' when fan_out = 0 then 'dependency-sink' end, case when hi then 'high-fan-in' end, case when ho then 'high-fan-out' end, case when agg then 'aggregator' end, case when bridge then 'bridge' end, case when near = 1 and not agg then 'satellite' end, case when cycle is not null then 'cycle-member' end], lambda r: r is not null), ',') as roles from tp"),
    "responsibility_regions": (responsibility_regions, f"with recursive {TOPOLOGY}, {REGIONS} select package, module, status, case when status = 'unresolved' then '-' else region end as region, case when status = 'unresolved' then reason else '-' end as reason from m5 left join rg using (g)"),
}
