"""History, gravity, profile and filter operators over a repository that the tables stand for.

Parts are files with a path, orders are commits and their lines the files they change; a package is
a fortieth of the parts. Two following lines of an order with the largest quantity are a dependency
between two files, so the graph grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, stats
from ..operators import commits, filters, graph, gravity, history, profiles
from ..operators.deal import deal
from .tables import count, lines, table

PATH = """'p' || (p_partkey % 40) || case p_size % 10 when 0 then '/f' || p_partkey || '/package.json' when 1 then '/test/f' || p_partkey || '.ts'
  when 2 then '/src/f' || p_partkey || '.stories.tsx' when 3 then '/docs/f' || p_partkey || '.md' when 4 then '/.f' || p_partkey
  when 5 then '/src/f' || p_partkey || '.spec.js' when 6 then '/dist/f' || p_partkey || '.ts' else '/src/f' || p_partkey || '.ts' end"""
ADDED = "case when l_returnflag <> 'N' then cast(l_quantity as bigint) end"
GONE = "case when l_linestatus = 'F' then cast(l_linenumber as bigint) end"
KIND = "case when p_size % 10 in (0, 4) then 'config' when p_size % 10 in (1, 5) then 'test' when p_size % 10 = 2 then 'story' when p_size % 10 = 3 then 'other' else 'source' end"
FILES = f"fs as (select p_partkey, {PATH} as path, 'p' || (p_partkey % 40) as owner, {KIND} as kind, p_size from part)"
SINCE = "(select max(o_orderdate) from orders) - interval 365 days"


def _files(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(PATH).alias("path"), F.concat(F.lit("p"), F.expr("p_partkey % 40")).alias("owner"), "p_size")


def _changes(spark, d):
    n = count(spark, d, "lineitem")
    rows = deal(lines(spark, d), n, "l_partkey").join(deal(_files(spark, d).select(F.col("p_partkey").alias("l_partkey"), "path"), n, "l_partkey"), "l_partkey")
    return rows.select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"), "path", F.expr(ADDED).alias("additions"), F.expr(GONE).alias("deletions"))


def _eligible(spark, d):
    changes, files = _changes(spark, d), _files(spark, d)
    last = table(spark, d, "orders").agg((F.max("o_orderdate") - F.expr("interval 365 days")).alias("_since"))  # one row
    changes = changes.join(F.broadcast(last)).filter("ts >= _since").drop("_since")
    return commits.eligible_changes(changes, files.filter("p_size <> 50").select("path"), number=count(spark, d, "lineitem")), files.select("path", "owner")


ELIGIBLE = f"""{FILES}, ec as (select o_orderkey as commit, path, owner, kind, min(o_orderdate) as ts, sum({ADDED})::bigint as additions, sum({GONE})::bigint as deletions
  from lineitem join orders on l_orderkey = o_orderkey join fs on fs.p_partkey = l_partkey where o_orderdate >= {SINCE} and p_size <> 50 and p_size % 10 not in (3, 6) group by 1, 2, 3, 4),
cm as (select commit, min(ts) as ts, count(*) as files, count(*) filter (kind = 'config') as config, count(*) filter (kind = 'other') as other, count(*) filter (kind = 'source') as source,
  count(*) filter (kind = 'story') as story, count(*) filter (kind = 'test') as test, array_to_string(list_sort(list(distinct owner)), '|') as packages, count(distinct owner) as n_packages,
  sum(additions)::bigint as additions, sum(deletions)::bigint as deletions from ec group by 1),
co as (select *, case when config / files >= 0.5 then 'config-dominant' when config / files <= 0.25 then 'source-dominant' else 'mixed' end as composition from cm),
cs as (select *, files - config - other > 40 or (composition = 'config-dominant' and n_packages >= 5) as oversized from co)"""
EDGE = """ed as (select distinct case when a.l_tax > 0 then least(a.l_partkey, b.l_partkey) else greatest(a.l_partkey, b.l_partkey) end as src,
  case when a.l_tax > 0 then greatest(a.l_partkey, b.l_partkey) else least(a.l_partkey, b.l_partkey) end as dst
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_quantity = 50 and a.l_partkey <> b.l_partkey)"""
OWNED = "oe as (select distinct 'p' || (src % 40) as \"from\", 'p' || (dst % 40) as \"to\" from ed where src % 40 <> dst % 40)"
RADIUS = f"""{ELIGIBLE}, {EDGE}, {OWNED}, mt as (select commit, count(*) as target_files from ec where owner = 'p7' group by 1),
tc as (select distinct commit, owner from ec), bx as (select a.commit, count(*) as n from tc a join oe on oe."from" = a.owner join tc b on b.commit = a.commit and b.owner = oe."to" group by 1),
rd as (select cs.*, target_files, coalesce(n, 0) as boundaries, case when additions is not null or deletions is not null then coalesce(additions, 0) + coalesce(deletions, 0) end as lines_changed
  from cs join mt on mt.commit = cs.commit left join bx on bx.commit = cs.commit where not oversized)"""


def module_graph(spark, d):
    """(nodes, edges) of the files by their key."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    after = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    n, keys = count(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    pairs = deal(rows.filter("l_quantity = 50"), n, *keys).join(deal(after, n, *keys), keys)
    low, high = F.least("l_partkey", "b"), F.greatest("l_partkey", "b")
    edges = pairs.select(F.when(F.col("l_tax") > 0, low).otherwise(high).alias("src"), F.when(F.col("l_tax") > 0, high).otherwise(low).alias("dst"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id")), graph.cut(graph.simple(edges))


def _owner_edges(spark, d):
    _, edges = module_graph(spark, d)
    named = edges.select(F.concat(F.lit("p"), F.expr("src % 40")).alias("from"), F.concat(F.lit("p"), F.expr("dst % 40")).alias("to"))
    return named.filter("`from` <> `to`").distinct()


def _known(df, *columns):
    """Sums that are null, as -1."""
    return df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in columns})


def eligible_commits(spark, d):
    rows, owners = _eligible(spark, d)
    return _known(commits.eligible_commits(rows, owners), "additions", "deletions")


def _radius(spark, d):
    rows, owners = _eligible(spark, d)
    n = count(spark, d, "lineitem")
    return commits.change_radius(rows, commits.eligible_commits(rows, owners, number=n), owners, _owner_edges(spark, d), "p7", n)


def change_radius(spark, d):
    return _known(_radius(spark, d), "additions", "deletions", "lines_changed").select("commit", "files", "n_packages", "packages", "boundaries", "composition", "additions", "deletions", "lines_changed", "target_files", F.round("target_share", 9).alias("target_share"))


def radius_totals(spark, d):
    return commits.radius_totals(_radius(spark, d)).withColumns({c: F.round(c, 9) for c in ("cross_package_rate", "boundary_rate")})


def package_combinations(spark, d):
    rows, owners = _eligible(spark, d)
    return commits.combinations(commits.eligible_commits(rows, owners).filter("not oversized"), 25)


def rename_finals(spark, d):
    p = table(spark, d, "part")
    renames = p.filter("p_size % 3 > 0").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1).alias("new"))
    return history.rename_finals(renames)


def _gravity(spark, d):
    return gravity.gravity(*module_graph(spark, d))


def gravity_rows(spark, d):
    return _gravity(spark, d).withColumns({c: F.round(c, 9) for c in ("dependency_reach", "dependent_reach")})


def grouped_layers(spark, d):
    nodes, edges = module_graph(spark, d)
    parts = graph.cut(graph.strong_components(nodes, edges))
    return gravity.grouped_layers(graph.layers(parts, edges))


def _functions(spark, d):
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'A' and l_discount >= 0.05")
    return rows.select(F.col("l_partkey").alias("file"), F.expr("cast(l_quantity as bigint) % 9").alias("control"), F.expr("l_linenumber % 3").alias("expression"), F.expr("l_linenumber % 6").alias("nesting"), F.expr("cast(l_quantity as bigint)").alias("statements"))


FN = "fn as (select l_partkey as file, cast(l_quantity as bigint) % 9 as control, l_linenumber % 3 as expression, l_linenumber % 6 as nesting, cast(l_quantity as bigint) as statements from lineitem where l_returnflag = 'A' and l_discount >= 0.05)"
CHURN = f"{FILES}, cn as (select l_partkey, count(distinct l_orderkey) as commits, sum(cast(l_quantity as bigint))::bigint as lines_changed from lineitem group by 1), ch as (select f.p_partkey as file, kind, owner, commits, lines_changed, (rank() over (partition by kind order by commits) - 1) / count(*) over (partition by kind) as commit_rank from fs f join cn on cn.l_partkey = f.p_partkey)"


def _churn(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.countDistinct("l_orderkey").alias("commits"), F.sum(F.col("l_quantity").cast("long")).alias("lines_changed"))
    files = _files(spark, d).select(F.col("p_partkey").alias("file"), scalar.file_kind(F.col("path")).alias("kind"), "owner")
    return stats.with_strict_rank(rows.join(files, "file"), "commits", ["kind"], "commit_rank")


def file_complexity(spark, d):
    return gravity.file_complexity(_functions(spark, d))


def hotspots(spark, d):
    weights = graph.degrees(*module_graph(spark, d))
    out = gravity.hotspots(_churn(spark, d), gravity.file_complexity(_functions(spark, d)), weights)
    return out.withColumns({c: F.round(c, 9) for c in ("commit_rank", "complexity_rank")})


def structural_hubs(spark, d):
    from dataclasses import replace

    from ..policy import DEFAULT

    weights = graph.degrees(*module_graph(spark, d))
    policy = replace(DEFAULT, structural_hub_percentile=0.5, structural_hub_fan_in=2)  # the tables' graph is thin
    return gravity.structural_hubs(_churn(spark, d), weights, _functions(spark, d), policy).withColumn("commit_rank", F.round("commit_rank", 9))


def frequent_change(spark, d):
    rows = _churn(spark, d).select(F.col("owner").alias("package"), "file", "kind", "commits", "lines_changed", "commit_rank")
    return gravity.frequent_change(rows).withColumn("commit_rank", F.round("commit_rank", 9))


def file_kinds(spark, d):
    return _files(spark, d).select("path", scalar.file_kind(F.col("path")).alias("kind"))


def _uses(spark, d):
    """A line is a use by the customer's package of a supplier's symbol (part)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 12).alias("consumer"))
    return lines(spark, d).join(c, "o_custkey").select(F.col("l_suppkey").alias("id"), "consumer", F.col("l_partkey").alias("symbol"), F.col("o_orderkey").alias("site"), "l_returnflag").filter("(consumer * 7 + id) % 5 < 2 or id % 9 = 0")


USES = "us as (select l_suppkey as id, c_custkey % 12 as consumer, l_partkey as symbol, o_orderkey as site, l_returnflag from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey where ((c_custkey % 12) * 7 + l_suppkey) % 5 < 2 or l_suppkey % 9 = 0)"
SURFACE = f"""{USES}, uc as (select id, consumer, count(*) as n, count(distinct symbol) as syms from us group by 1, 2), ut as (select id, count(distinct consumer) as consumers, count(*) as total, count(distinct symbol) as symbols from us group by 1),
up as (select distinct id, first_value(consumer) over w as prim, first_value(n) over w as refs, first_value(syms) over w as psyms from uc window w as (partition by id order by n desc, consumer)),
sf as (select up.id, ut.consumers, id2.deps as dependencies, refs as "references", refs / total as reference_share, psyms / symbols as surface_share, prim % 3 = up.id % 3 as "returns", (select 1.0) as one, symbols, total,
  (select sum(syms) from uc where uc.id = up.id) / symbols as distribution from up join ut on ut.id = up.id join (select s_suppkey, s_suppkey % 8 as deps from supplier) id2 on id2.s_suppkey = up.id)"""


def _surface(spark, d):
    uses = _uses(spark, d)
    by = uses.groupBy("id", "consumer").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("syms"))
    best = by.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "consumer", "syms")).alias("b"), F.count("*").alias("consumers"), F.sum("syms").alias("all_syms"))
    total = uses.groupBy("id").agg(F.count("*").alias("total"), F.countDistinct("symbol").alias("symbols"))
    rows = best.join(total, "id")
    return rows.select(
        "id", "consumers", F.expr("id % 8").alias("dependencies"), (-F.col("b.n")).alias("references"), (-F.col("b.n") / F.col("total")).alias("reference_share"), (F.col("b.syms") / F.col("symbols")).alias("surface_share"),
        F.expr("b.consumer % 3 = id % 3").alias("returns"), F.lit(True).alias("in_use"), "symbols", "total", (F.col("all_syms") / F.col("symbols")).alias("distribution"),
    )


def consumption_shapes(spark, d):
    return profiles.consumption_shapes(_surface(spark, d))


PROFILE = f"""{SURFACE}, pf as (select id, id % 5 as fan_in, (id * 3) % 7 as fan_out, (id % 10) / 10 as dependency_reach, (id % 7) / 7 as dependent_reach, consumers, distribution, symbols as public_symbols, (id % 4) / 8 as utilization, reference_share as primary_share,
  total as outgoing_sites, total as incoming_references, surface_share as destination_share, id % 3 as package_depth, id % 17 as module_depth, case when id % 6 > 0 then id % 30 end as top_fan_in, id % 5 as branch_heavy from sf)"""


def _profile(spark, d):
    s = _surface(spark, d)
    return s.select(
        "id", F.expr("id % 5").alias("fan_in"), F.expr("(id * 3) % 7").alias("fan_out"), F.expr("(id % 10) / 10").alias("dependency_reach"), F.expr("(id % 7) / 7").alias("dependent_reach"), "consumers", "distribution",
        F.col("symbols").alias("public_symbols"), F.expr("(id % 4) / 8").alias("utilization"), F.col("reference_share").alias("primary_share"), F.col("total").alias("outgoing_sites"), F.col("total").alias("incoming_references"),
        F.col("surface_share").alias("destination_share"), F.expr("id % 3").alias("package_depth"), F.expr("id % 17").alias("module_depth"), F.expr("case when id % 6 > 0 then id % 30 end").alias("top_fan_in"), F.expr("id % 5").alias("branch_heavy"),
    )


def architectural_profiles(spark, d):
    return profiles.architectural_profile(_profile(spark, d))


def structural_pressures(spark, d):
    return profiles.structural_pressures(_profile(spark, d)).select("id", "pressure")


def boundary_shapes(spark, d):
    b = _uses(spark, d).groupBy("id", "consumer").agg(F.countDistinct("site").alias("sites"), F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"))
    shape = profiles.boundary_shape(F.col("sites"), F.when(F.col("id") % 2 == 0, F.col("n")), F.col("symbols"), F.expr("(consumer % 4) / 4"))
    return b.select("id", "consumer", shape.alias("shape")).filter("shape is not null")


def pattern_strengths(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("s"), F.min("value").alias("v"))
    return g.select("user_id", profiles.pattern_strength(F.col("n"), F.lit(3), F.col("s"), F.col("v") >= 1).alias("strength"))


def _concepts(spark, d):
    rows = table(spark, d, "lineitem").filter("l_quantity >= 40")
    return rows.select(F.col("l_partkey").alias("concept"), (F.col("l_suppkey") % 15).alias("package"), (F.col("l_returnflag") == "A").cast("long").alias("representations"), (F.col("l_returnflag") != "A").cast("long").alias("references"))


CONCEPTS = """ct as (select l_partkey as concept, l_suppkey % 15 as package, count(*) filter (l_returnflag = 'A') as r, count(*) filter (l_returnflag <> 'A') as f from lineitem where l_quantity >= 40 group by 1, 2),
cd as (select concept, count(*) as packages, sum(r)::bigint as representations, count(*) filter (r > 0) as representations_packages, arg_min(package, (-r, package)) filter (r > 0) as representations_primary, max(r) / nullif(sum(r), 0) as representations_share,
  sum(f)::bigint as "references", count(*) filter (f > 0) as references_packages, arg_min(package, (-f, package)) filter (f > 0) as references_primary, max(f) / nullif(sum(f), 0) as references_share from ct group by 1)"""


def concept_distribution(spark, d):
    out = profiles.concept_distribution(_concepts(spark, d))
    return out.select("concept", "packages", *[c for m in ("representations", "references") for c in (m, f"{m}_packages", F.coalesce(F.col(f"{m}_primary"), F.lit(-1)).alias(f"{m}_primary"), F.coalesce(F.round(f"{m}_share", 9), F.lit(-1.0)).alias(f"{m}_share"))])


def distribution_shapes(spark, d):
    c = profiles.concept_distribution(_concepts(spark, d))
    rows = c.select(F.col("concept").alias("id"), "packages", F.expr("concept % 3").alias("implementation_packages"), F.col("references_packages").alias("reference_packages"), F.col("references_share").alias("reference_share"), "representations", F.col("representations_share").alias("representation_share"))
    return profiles.distribution_shapes(rows)


def _consumers(spark, d):
    return table(spark, d, "lineitem").filter("l_discount >= 0.08").select(F.col("l_suppkey").alias("symbol"), F.col("l_partkey").alias("module"), F.expr("l_partkey % 6").alias("region"), F.col("l_linenumber").alias("import_sites"), F.col("l_quantity").cast("long").alias("bindings"))


def locality_shares(spark, d):
    out = profiles.locality_shares(_consumers(spark, d), ["region"])
    return out.withColumns({c: F.round(c, 9) for c in ("share", "import_site_share", "binding_share")})


LOCAL = """lc as (select l_suppkey as symbol, l_partkey as module, l_partkey % 6 as region, l_linenumber as s, cast(l_quantity as bigint) as b from lineitem where l_discount >= 0.08),
lt as (select symbol, count(distinct module) as m, sum(s) as s, sum(b) as b from lc group by 1),
lr as (select symbol, region, count(distinct module) as modules, sum(s)::bigint as import_sites, sum(b)::bigint as bindings from lc group by 1, 2)"""


def symbol_distribution(spark, d):
    p = table(spark, d, "part")
    rows = p.select(
        F.col("p_partkey").alias("symbol"), F.expr("p_size % 4").alias("consumers"), F.expr("p_partkey % 3").alias("directories"), F.expr("p_partkey % 5").alias("regions"), F.expr("(p_size % 11) / 10").alias("top_share"),
        F.expr("p_partkey % 4").alias("significant"), F.expr("p_partkey % 2").alias("home"), F.expr("p_size % 2").alias("top_region"), F.expr("element_at(array('same', 'ancestor', 'descendant', 'disjoint'), cast(p_partkey % 4 + 1 as int))").alias("relation"),
    )
    return profiles.symbol_distribution(rows)


def opportunities(spark, d):
    s = _surface(spark, d).withColumn("one_way", ~F.col("returns"))
    return profiles.opportunities(s).withColumn("evidence", F.round("evidence", 9))


def internalize(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") > 10).alias("public"))
    used = table(spark, d, "lineitem").filter("l_quantity >= 45").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("references"), F.sum("l_linenumber").alias("import_sites"))
    return profiles.internalize(p.join(used, "id", "left"))


def propagation(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = table(spark, d, "lineitem").filter("l_quantity >= 47").join(s, "l_suppkey").select(
        F.col("l_partkey").alias("concept"), F.expr("case when l_partkey % 7 > 0 then l_partkey % 4 end").alias("home_layer"), F.expr("case when s_nationkey > 4 then s_nationkey end").alias("package"),
        F.expr("case s_nationkey % 4 when 0 then 'disconnected' when 1 then 'unmeasured' else 'direct' end").alias("relation"), F.expr("s_nationkey % 5").alias("layer"),
    )
    return profiles.propagation(rows)


def file_roles(spark, d):
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("file"), F.expr("p_size = 1").alias("composition_root"), F.expr("case when p_size % 6 = 0 then null when p_size % 6 = 1 then 'mixed-scope' else 'scope' end").alias("scopes"), F.expr("p_partkey % 2").alias("local_groups"),
        F.expr("p_partkey % 3").alias("cross"), F.expr("p_partkey % 5").alias("package_wide"), F.expr("p_size % 4").alias("symbols"), F.expr("p_partkey % 4").alias("unresolved"),
    )
    return profiles.file_roles(rows).filter("role is not null")


def centers(spark, d):
    rows = lines(spark, d).select(F.col("l_suppkey").alias("concept"), F.col("l_returnflag").alias("dimension"), (F.col("o_custkey") % 25).alias("package"), F.when(F.col("o_custkey") % 3 > 0, F.col("l_linenumber")).otherwise(0).cast("long").alias("value"))
    seed = table(spark, d, "supplier").select(F.col("s_suppkey").alias("concept"), (F.col("s_nationkey")).cast("long").alias("package"))
    return profiles.centers(rows, seed, 20, 0.06).withColumn("share", F.round("share", 9))


def weighted_centers(spark, d):
    rows = table(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("concept"), F.col("o_orderstatus").alias("family"), (F.col("o_custkey") % 9).alias("package")).agg(F.count("*").alias("n"))
    total = rows.groupBy("concept", "family").agg(F.sum("n").alias("t"))
    shares = rows.join(total, ["concept", "family"]).select("concept", "family", "package", (F.col("n") / F.col("t")).alias("share"))
    return profiles.weighted_centers(shares, {"F": 0.5, "O": 0.3}).withColumn("gravity", F.round("gravity", 9))


def workflow_rankings(spark, d):
    """Suppliers as workflows, but for every seventh; lines as their runs and their spend in two currencies."""
    r = lines(spark, d).withColumn("id", F.col("l_suppkey"))
    runs = r.select("id", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("started_at"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ended_at"), F.when(F.col("l_linenumber") == 7, "w").alias("workspace"))
    spend = r.select("id", F.when(F.col("l_returnflag") == "R", "EUR").otherwise("USD").alias("currency"), F.col("l_quantity").alias("amount"))
    known = table(spark, d, "supplier").filter("s_suppkey % 7 > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return profiles.workflow_rankings(runs, spend, known).withColumn("runs", F.coalesce("runs", F.lit(-1)))


def _runs(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("run-"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("queue"), F.concat(F.lit("step-"), F.expr("o_orderkey % 5")).alias("step"), F.concat(F.lit("def-"), F.expr("o_custkey % 3")).alias("definition"),
        F.expr("case o_orderstatus when 'O' then 'queued' when 'P' then 'running' else 'complete' end").alias("status"), F.create_map(F.lit("team"), F.concat(F.lit("t"), F.expr("o_custkey % 4")), F.lit("p"), F.col("o_orderstatus")).alias("tags"),
        F.struct(F.concat(F.lit("S"), "o_custkey").alias("session"), F.expr("case when o_orderkey % 2 = 0 then 'I' || o_orderkey end").alias("invocation"), F.lit(None).cast("string").alias("subject")).alias("links"),
        F.array(F.lit("a"), F.concat(F.lit("b"), F.expr("o_orderkey % 3"))).alias("step_path"), F.col("o_orderdate").alias("created_at"), "o_orderkey", "o_custkey",
    )


def runs_query(spark, d):
    q = filters.RunQuery(status=["queued", "running"], tags={"team": "t1"}, definition="def-1", links={"subject": None}, search=" s1 ")
    return filters.runs(_runs(spark, d), q).select("id", "queue", "status")


def jobs_query(spark, d):
    return filters.jobs(_runs(spark, d), "queued", "def-2", {"invocation": None}).select("id", "status")


def suspensions_query(spark, d):
    rows = _runs(spark, d).select("id", F.col("id").alias("run"), F.col("queue").alias("kind"), F.col("step").alias("name"), F.expr("o_orderkey % 4").alias("occurrence"), "step_path", "status")
    return filters.suspensions(rows, kind="1-URGENT", occurrence=2, step_path=["a", "b1"], status=("queued", "complete")).select("id", "name")


def _task_rows(spark, d):
    return _runs(spark, d).select("id", "status", F.expr("case when o_orderkey % 3 = 0 then 'run-' || (o_orderkey - 1) end").alias("parent_id"), F.array("definition", "queue").alias("tags"))


def root_tasks(spark, d):
    return filters.tasks(_task_rows(spark, d), "queued", None, ["def-1"], ["1-URGENT", "2-HIGH"]).select("id")


def child_tasks(spark, d):
    return filters.tasks(_task_rows(spark, d), parent="run-5").select("id", "status")


def artifacts_query(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.expr("case when p_size > 40 then p_size end").alias("archived_at"))
    return filters.artifacts(p, "1", "Brand#12").select("id", "name")


def directions_query(spark, d):
    rows = _uses(spark, d).groupBy("id", "consumer", "l_returnflag").agg(F.count("*").alias("count"))
    rows = rows.select(F.concat_ws(":", "id", "consumer", "l_returnflag").alias("id"), F.col("id").alias("from"), F.col("consumer").alias("to"), F.col("l_returnflag").alias("role"), "count")
    return filters.directions(rows, to=4, role="N", least=3)


def reviews_query(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("case p_size % 3 when 0 then 'keep' when 1 then 'move' end").alias("disposition"), F.expr("p_size % 2 = 0").alias("baseline_dominated"), F.col("p_brand").alias("declared_package"), F.col("p_type").alias("gravity_center"))
    return filters.reviews(p, "move", True, "Brand#12").select("id", "gravity_center")


def patterns_query(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("kinds"), F.array_sort(F.collect_set("l_linenumber")).alias("packages"), F.count("*").alias("n"))
    g = g.select(F.col("l_suppkey").alias("id"), F.expr("case when l_suppkey % 2 = 0 then 'even' else 'odd' end").alias("family"), "kinds", "packages", F.expr("case when n % 3 = 0 then 'strong' else 'limited' end").alias("strength"))
    return filters.patterns(g, "odd", "R", 7, "strong").select("id")


def recall_page(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), "text", F.expr("doc_id % 97").alias("created_at"))
    return filters.recall(rows, "THE", "en", 20, 5).select("id", "score")


def feed(spark, d):
    return filters.feed(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("posted_at")), 30).select("id")


def recoverable_runs(spark, d):
    return filters.recoverable(_runs(spark, d), "1-URGENT").select("id", "status")


def run_buckets(spark, d):
    rows = _runs(spark, d).select(scalar.run_bucket(F.col("status"), F.expr("o_orderkey % 7 = 0")).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("runs"))


def miscentering(spark, d):
    r = table(spark, d, "lineitem").select((F.col("l_partkey") % 400).alias("concept"), F.expr("case when l_partkey % 3 = 0 then l_partkey % 5 when l_suppkey % 3 > 0 then l_partkey % 4 else l_suppkey % 6 end").alias("package"), F.expr("element_at(array('behavior', 'representation', 'reference', 'dependency'), cast((l_orderkey + l_linenumber) % 4 + 1 as int))").alias("family")).filter("concept % 7 > 0 or family <> 'representation'")
    n = r.groupBy("concept", "family", "package").agg(F.count("*").alias("n"))
    t = r.groupBy("concept", "family").agg(F.count("*").alias("t"))
    shares = n.join(t, ["concept", "family"]).select("concept", "family", "package", (F.col("n") / F.col("t")).alias("share"))
    e = lambda x, name: F.expr(x).alias(name)
    concepts = table(spark, d, "part").select((F.col("p_partkey") % 400).alias("concept")).distinct().select(
        "concept", e("concept % 6", "home"), e("concept % 11", "governing"), e("concept % 5", "strong"), e("concept % 4", "weak"), e("concept % 9", "foreign_behaviors"),
        e("case when concept % 4 > 0 then concept % 5 end", "evolution_center"), e("concept % 8 = 0", "implementation_split"), e("concept % 10 = 0", "reference_distributed"),
    )
    crossings = r.filter("family = 'dependency' and concept % 2 = 0").select("concept", "package").distinct()
    return profiles.miscentering(concepts, shares, crossings)


MIS = """r as (select l_partkey % 400 as concept, case when l_partkey % 3 = 0 then l_partkey % 5 when l_suppkey % 3 > 0 then l_partkey % 4 else l_suppkey % 6 end as package, ['behavior', 'representation', 'reference', 'dependency'][((l_orderkey + l_linenumber) % 4 + 1)::int] as family from lineitem),
n as (select concept, family, package, count(*) as n from r where concept % 7 > 0 or family <> 'representation' group by 1, 2, 3), s as (select concept, family, package, n / sum(n) over (partition by concept, family) as share, case family when 'behavior' then 0.6::double when 'representation' then 0.25::double when 'reference' then 0.15::double end as w from n),
cs as (select distinct p_partkey % 400 as concept, p_partkey % 400 % 6 as home from part), tw as (select concept, sum(w) as t from (select distinct concept, family, w from s where w is not null) group by 1),
g0 as (select s.concept, package, sum(w * share) / any_value(t) as g from s join tw on tw.concept = s.concept where w is not null group by 1, 2), g as (select * from g0 where concept in (select concept from cs) union all select concept, home, 0 from cs where (concept, home) not in (select concept, package from g0)),
c as (select g.concept, any_value(home) as home, arg_min(package, (-g, package)) filter (package <> home) as top, coalesce(max(g) filter (package <> home), 0) as tg, coalesce(max(g) filter (package = home), 0) as hg, max(g) as largest, count(*) filter (g >= 0.2) as pieces from g join cs on cs.concept = g.concept group by 1),
f as (select c.concept, coalesce(max(share) filter (family = 'behavior' and package = home), 0) as bh, coalesce(max(share) filter (family = 'representation' and package = home), 0) as rh, coalesce(max(share) filter (family = 'behavior' and package = top), 0) >= 0.5 as bt, coalesce(max(share) filter (family = 'representation' and package = top), 0) >= 0.5 as rt, coalesce(max(share) filter (family = 'reference' and package = top), 0) >= 0.5 as ft, coalesce(max(share) filter (family = 'dependency' and package = top), 0) >= 0.5 as dt,
  coalesce(max(share) filter (family = 'behavior') < 0.5 and count(*) filter (family = 'behavior' and share >= 0.2) >= 2, false) as bd, coalesce(max(share) filter (family = 'representation') < 0.5 and count(*) filter (family = 'representation' and share >= 0.2) >= 2, false) as rd, coalesce(max(share) filter (family = 'reference') < 0.5 and count(*) filter (family = 'reference' and share >= 0.2) >= 2, false) as fd,
  coalesce(bool_or(package <> home and share >= 0.5 and family in ('reference', 'dependency') and exists (select 1 from g where g.concept = s.concept and g.package = s.package)), false) as led from c left join s on s.concept = c.concept group by 1),
x as (select distinct concept, package from r where family = 'dependency' and concept % 2 = 0), m as (select x.concept, bool_or(package = top) as xt from x join c on c.concept = x.concept group by 1),
z as (select c.*, f.* exclude (concept), m.concept is not null as crossed, coalesce(xt, false) as xt, case when c.concept % 4 > 0 then c.concept % 5 end as ev from c join f on f.concept = c.concept left join m on m.concept = c.concept)"""


def _pressure_facts(spark, d):
    s = table(spark, d, "supplier")
    e = lambda x, name: F.expr(x).alias(name)
    return s.select(
        F.col("s_suppkey").alias("id"), e("s_suppkey % 23 + 5", "eligible"), e("(s_suppkey % 10) / 10", "boundary_rate"), e("s_suppkey % 3", "direct_pairs"), e("case when s_suppkey % 2 = 0 then s_suppkey % 17 end", "primary_commits"), e("s_suppkey % 13", "primary_combinations"),
        e("s_suppkey % 4 = 0", "seam_reinforced"), e("s_suppkey % 5 = 0", "hub_evidence"), e("s_suppkey % 3 = 1", "leaf"), e("s_suppkey % 4", "pressures"), e("(s_suppkey % 6) / 10", "cross_rate"), e("s_suppkey % 2", "hotspots"), e("s_suppkey % 5", "recurring"),
        e("s_suppkey % 19", "partner_commits"), e("case when s_suppkey % 7 > 0 then s_suppkey % 21 end", "combination_commits"),
    )


def evolutionary_pressures(spark, d):
    static = structural_pressures(spark, d)
    return profiles.evolutionary_pressure(static, _pressure_facts(spark, d))


def tensions(spark, d):
    p = table(spark, d, "lineitem").filter("l_quantity >= 45").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("left"), (F.col("l_partkey") + 1).alias("right"), F.expr("case when l_partkey % 3 = 0 then 'direct' else 'none' end").alias("static_path"), F.expr("case when l_partkey % 4 = 0 then 'source-test' else 'source-source' end").alias("context"), F.col("l_linenumber").alias("commits"))
    return profiles.tensions(_pressure_facts(spark, d), p)


RUNS = """rn as (select 'run-' || o_orderkey as id, o_orderpriority as queue, 'step-' || (o_orderkey % 5) as step, 'def-' || (o_custkey % 3) as definition, case o_orderstatus when 'O' then 'queued' when 'P' then 'running' else 'complete' end as status,
  't' || (o_custkey % 4) as team, 'S' || o_custkey as session, case when o_orderkey % 2 = 0 then 'I' || o_orderkey end as invocation, o_orderkey, o_orderdate from orders)"""
REACHED = f"{EDGE}, w as (select src, dst from ed union select w.src, ed.dst from w join ed on w.dst = ed.src), r as (select * from w where src <> dst)"
LEVELS = f"""{REACHED}, mm as (select a.src as id, min(a.dst) as low, count(*) as n from r a join r b on a.src = b.dst and a.dst = b.src group by 1),
cc as (select p_partkey as id, least(p_partkey, coalesce(low, p_partkey)) as c, coalesce(n, 0) + 1 as size from part left join mm on mm.id = p_partkey),
gg as (select distinct a.c as s, b.c as t from ed join cc a on a.id = ed.src join cc b on b.id = ed.dst where a.c <> b.c),
lu as (select distinct c as s, 0 as l from cc union select gg.s, lu.l + 1 from gg join lu on gg.t = lu.s), ld as (select distinct c as s, 0 as l from cc union select gg.t, ld.l + 1 from gg join ld on gg.s = ld.s)"""
SIG = "array_to_string(list_filter([{}], lambda x: x is not null), ',')"


def _sig(**rules: str) -> str:
    return SIG.format(", ".join(f"case when {c} then '{n.replace('_', '-')}' end" for n, c in rules.items()))


QUERIES = {
    "eligible_commits": (eligible_commits, f"with {ELIGIBLE} select * replace (coalesce(additions, -1) as additions, coalesce(deletions, -1) as deletions) from cs"),
    "change_radius": (change_radius, f"with {RADIUS} select commit, files, n_packages, packages, boundaries, composition, coalesce(additions, -1) as additions, coalesce(deletions, -1) as deletions, coalesce(lines_changed, -1) as lines_changed, target_files, round(target_files / files, 9) as target_share from rd"),
    "radius_totals": (radius_totals, f"with {RADIUS} select count(*) as commits, round(avg((n_packages > 1)::int), 9) as cross_package_rate, round(avg((boundaries > 0)::int), 9) as boundary_rate, " + ", ".join(f"max({c})::bigint as {c}_max, " + ", ".join(f"quantile_disc({c}, {q})::bigint as {c}_p{int(q * 100)}" for q in (0.5, 0.9, 0.95)) for c in ("files", "n_packages", "boundaries", "source")) + " from rd"),
    "package_combinations": (package_combinations, f"with {ELIGIBLE} select packages, n_packages, count(*) as commits from cs where not oversized and n_packages > 1 group by 1, 2 order by commits desc, n_packages, packages limit 25"),
    "rename_finals": (rename_finals, "with g as (select p_partkey as old, p_size % 3 > 0 as moves from part) select old, coalesce((select min(b.old) from g b where b.old > a.old and not b.moves), (select max(old) + 1 from g)) as final from g a where moves"),
    "gravity_rows": (gravity_rows, f"with recursive {LEVELS}, fi as (select dst as id, count(*) as n from ed group by 1), fo as (select src as id, count(*) as n from ed group by 1), up as (select s, max(l) as l from lu group by 1), dn as (select s, max(l) as l from ld group by 1), rd as (select src as id, count(*) as n from r group by 1), rt as (select dst as id, count(*) as n from r group by 1) select cc.id, case when size > 1 then size else 0 end as cycle, dn.l as downstream, up.l as upstream, coalesce(fi.n, 0) as fan_in, coalesce(fo.n, 0) as fan_out, coalesce(rd.n, 0) as dependencies, coalesce(rt.n, 0) as dependents, round(coalesce(rd.n, 0) / ((select count(*) from part) - 1), 9) as dependency_reach, round(coalesce(rt.n, 0) / ((select count(*) from part) - 1), 9) as dependent_reach from cc join up on up.s = cc.c join dn on dn.s = cc.c left join fi on fi.id = cc.id left join fo on fo.id = cc.id left join rd on rd.id = cc.id left join rt on rt.id = cc.id"),
    "grouped_layers": (grouped_layers, f"with recursive {LEVELS}, up as (select s, max(l) as layer from lu group by 1) select layer, count(*) as nodes, min(id) as first, max(id) as last from cc join up on up.s = cc.c group by 1"),
    "file_complexity": (file_complexity, f"with {FN} select file, count(*) as functions, sum(control)::bigint as control_total, sum(expression)::bigint as expression_total, sum(statements)::bigint as statements_total, max(control) as control_max, max(expression) as expression_max, max(nesting) as nesting_max, max(statements) as statements_max from fn group by 1"),
    "hotspots": (hotspots, f"with {CHURN}, {FN}, {EDGE}, fc as (select file, count(*) as functions, sum(control) as ct, max(control) as cm, max(nesting) as nm from fn group by 1), el as (select ch.*, coalesce(functions, 0) as functions, coalesce(ct, 0) as ct, coalesce(cm, 0) as cm, coalesce(nm, 0) as nm, (rank() over (order by coalesce(cm, 0)) - 1) / count(*) over () as complexity_rank from ch left join fc on fc.file = ch.file where kind = 'source'), q as (select el.*, (select count(*) from ed where dst = el.file) as fan_in, (select count(*) from ed where src = el.file) as fan_out from el where commit_rank >= 0.9 and (cm >= 6 or nm >= 4 or (ct >= 15 and functions >= 5))) select file, commits, round(commit_rank, 9) as commit_rank, round(complexity_rank, 9) as complexity_rank, fan_in, fan_out, " + _sig(frequent_change="true", branch_heavy="cm >= 6", deep_control_flow="nm >= 4", complexity_dense="ct >= 15 and functions >= 5", architecturally_central="fan_in >= 20 or fan_out >= 10") + " as signals from q"),
    "structural_hubs": (structural_hubs, f"with {CHURN}, {FN}, {EDGE}, q as (select ch.*, (select count(*) from ed where dst = ch.file) as fan_in, (select count(*) from ed where src = ch.file) as fan_out, (select count(*) from fn where fn.file = ch.file) as functions from ch where kind = 'source' and commit_rank >= 0.5) select file, commits, round(commit_rank, 9) as commit_rank, fan_in, fan_out, functions from q where fan_in >= 2"),
    "frequent_change": (frequent_change, f"with {CHURN} select owner as package, file, commits, lines_changed, round(commit_rank, 9) as commit_rank from ch where kind = 'source' and commit_rank >= 0.9"),
    "file_kinds": (file_kinds, f"with {FILES} select path, kind from fs"),
    "consumption_shapes": (consumption_shapes, f"with {SURFACE} select id, " + _sig(single_consumer="consumers = 1", concentrated_consumption="reference_share >= 0.8 or surface_share >= 0.8", distributed_consumption='consumers >= 3 and "references" > 0 and reference_share < 0.5', high_fan_in="consumers >= 4", high_fan_out="dependencies >= 6", one_way_satellite='consumers = 1 and not "returns"', shared_hub='consumers >= 4 and "references" > 0 and reference_share < 0.5 and consumers > dependencies') + " as signals from sf"),
    "architectural_profiles": (architectural_profiles, f"with {PROFILE} select id, " + _sig(foundation_like="fan_in >= 2 and fan_out <= 1 and dependent_reach > dependency_reach", integration_like="fan_in <= 2 and fan_out >= 3 and dependency_reach > dependent_reach", shared_hub_like="fan_in >= 3 and consumers >= 3 and distribution >= 1.5", leaf_like="fan_in <= 1 and fan_out between 1 and 2", surface_heavy="public_symbols >= 20 and utilization <= 0.25", narrowly_consumed="consumers >= 1 and primary_share >= 0.8", broadly_consumed="consumers >= 3 and primary_share < 0.8") + " as signals from pf"),
    "structural_pressures": (structural_pressures, f"with {PROFILE} select id, 'surface-pressure' as pressure from pf where public_symbols >= 50 and utilization <= 0.25 and primary_share >= 0.8 union all select id, 'integration-pressure' from pf where fan_out >= 3 and dependency_reach >= 0.1 and outgoing_sites >= 50 union all select id, 'centralization-pressure' from pf where fan_in >= 3 and incoming_references >= 100 and destination_share >= 0.2 union all select id, 'internal-structure-pressure' from pf where module_depth - package_depth >= 10 and top_fan_in >= 20 and branch_heavy >= 3"),
    "boundary_shapes": (boundary_shapes, f"with {USES}, b as (select id, consumer, count(distinct site) as sites, case when id % 2 = 0 then count(*) end as n, count(distinct symbol) as symbols, (consumer % 4) / 4 as ds from us group by 1, 2), s as (select *, (sites >= 50 or coalesce(n >= 100, false)) and symbols >= 25 as broad, sites >= 20 and ds >= 0.5 as narrow from b) select id, consumer, case when broad and narrow then 'mixed' when broad then 'broad' else 'concentrated' end as shape from s where broad or narrow"),
    "pattern_strengths": (pattern_strengths, "with g as (select user_id, count(*) as n, count(distinct event_type) as s, min(value) as v from events group by 1) select user_id, case when n >= 6 and s >= 2 and v >= 1 then 'strong' when (n >= 3 and s >= 2) or n >= 6 then 'moderate' else 'limited' end as strength from g"),
    "concept_distribution": (concept_distribution, f"with {CONCEPTS} select concept, packages, representations, representations_packages, coalesce(representations_primary, -1) as representations_primary, coalesce(round(representations_share, 9), -1) as representations_share, \"references\", references_packages, coalesce(references_primary, -1) as references_primary, coalesce(round(references_share, 9), -1) as references_share from cd"),
    "distribution_shapes": (distribution_shapes, f"with {CONCEPTS} select concept as id, " + _sig(cross_package="packages > 1", local="packages <= 1", implementation_split="concept % 3 >= 2", reference_distributed="references_packages >= 3 and references_share <= 0.5", representation_concentrated="references_packages >= 2 and representations >= 3 and representations_share >= 0.75") + " as shapes from cd"),
    "locality_shares": (locality_shares, f"with {LOCAL} select lr.symbol, region, modules, import_sites, bindings, round(modules / m, 9) as share, round(import_sites / s, 9) as import_site_share, round(bindings / b, 9) as binding_share from lr join lt on lt.symbol = lr.symbol"),
    "symbol_distribution": (symbol_distribution, "with p as (select p_partkey as symbol, p_size % 4 as consumers, p_partkey % 3 as directories, p_partkey % 5 as regions, (p_size % 11) / 10 >= 0.6 as dom, p_partkey % 4 as sg, p_partkey % 2 = p_size % 2 as home, ['same', 'ancestor', 'descendant', 'disjoint'][(p_partkey % 4 + 1)::int] as rel from part), q as (select *, not dom and sg >= 2 as split, case when consumers = 1 then 'module-localized' when directories = 1 then 'directory-localized' when regions = 1 then 'region-localized' when dom or sg >= 2 then 'multi-region' else 'package-distributed' end as distribution from p) select symbol, distribution, case when consumers < 2 then 'unclear' when distribution = 'package-distributed' then 'distributed' when not dom then 'split' when home then case rel when 'same' then 'aligned' when 'ancestor' then 'broader-than-consumers' when 'descendant' then case when sg >= 2 then 'narrower-than-consumers' else 'aligned' end else 'cross-directory' end when rel = 'ancestor' then 'broader-than-consumers' else 'cross-region' end as placement from q"),
    "opportunities": (opportunities, f"with {SURFACE} select id, 'fold-package' as operation, round(0.3 + 0.2 * reference_share + 0.2 * surface_share + 0.15 * least(1, greatest(0, 2 - distribution)) + case when not \"returns\" then 0.15 else 0 end, 9)::double as evidence from sf where consumers = 1 union all select id, 'preserve-shared-boundary', round(0.4 * least(1, (consumers - 1) / 3) + 0.35 * (1 - reference_share) + 0.25 * least(1, greatest(0, distribution - 1)), 9)::double from sf where consumers >= 3 and reference_share <= 0.8"),
    "internalize": (internalize, "select p_partkey as id, 'internalize-symbol' as operation from part where p_size > 10 and p_partkey not in (select l_partkey from lineitem where l_quantity >= 45)"),
    "propagation": (propagation, "with x as (select l_partkey as concept, case when l_partkey % 7 > 0 then l_partkey % 4 end as h, case when s_nationkey > 4 then s_nationkey end as p, s_nationkey > 4 and s_nationkey % 4 > 1 as c, s_nationkey % 5 as l from lineitem join supplier on s_suppkey = l_suppkey where l_quantity >= 47), g as (select concept, any_value(h) as h, count(p) as n, bool_or(c) as c, bool_or(coalesce(c and l > h, false)) as u, bool_or(coalesce(c and l < h, false)) as d from x group by 1) select concept, case when h is null then 'unmeasured' when n = 0 then 'same-layer' when not c then 'disconnected' when u and d then 'bidirectional' when u then 'upstream' when d then 'downstream' else 'same-layer' end as direction from g"),
    "file_roles": (file_roles, "with x as (select p_partkey as file, case when p_size = 1 then 'junction' when p_size % 6 = 0 then null when p_size % 6 = 1 then 'mixed' when p_partkey % 2 = 0 and p_partkey % 3 + p_partkey % 5 > 0 then 'commons' when p_size % 4 > 0 and p_partkey % 4 = p_size % 4 then 'unknown' end as role from part) select * from x where role is not null"),
    "centers": (centers, "with v as (select l_suppkey as concept, l_returnflag as dimension, o_custkey % 25 as package, sum(case when o_custkey % 3 > 0 then l_linenumber else 0 end)::bigint as v from lineitem join orders on o_orderkey = l_orderkey group by 1, 2, 3), t as (select concept, dimension, sum(v)::bigint as t from v group by 1, 2), b as (select v.*, row_number() over (partition by concept, dimension order by v desc, package <> s_nationkey, package) as r from v join supplier on s_suppkey = concept where v > 0) select b.concept, b.dimension, package as leader, v as value, round(v / t, 9) as share from b join t on t.concept = b.concept and t.dimension = b.dimension where r = 1 and t >= 20 and v / t >= 0.06"),
    "weighted_centers": (weighted_centers, "with n as (select o_custkey % 200 as concept, o_orderstatus as family, o_custkey % 9 as package, count(*) as n from orders group by 1, 2, 3), s as (select *, n / sum(n) over (partition by concept, family) as share, case family when 'F' then 0.5 when 'O' then 0.3 end as w from n), t as (select concept, sum(w) as t from (select distinct concept, family, w from s where w is not null) group by 1) select s.concept, package, round(sum(w * share)::double / any_value(t)::double, 9) as gravity from s join t on t.concept = s.concept where w is not null group by 1, 2"),
    "workflow_rankings": (workflow_rankings, "with r as (select l_suppkey as id, s_name as name, epoch_ms(l_shipdate) - epoch_ms(o_orderdate) as took, l_quantity as amount, l_returnflag, l_linenumber from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey and s_suppkey % 7 > 0), x as (select 'elapsed' as kind, id, name, sum(took)::double as value, count(*) as runs from r where took >= 0 and l_linenumber <> 7 group by 2, 3 union all select 'spend', id, name, sum(amount)::double, -1 from r where l_returnflag <> 'R' group by 2, 3) select kind, id, name, value, runs, row_number() over (partition by kind order by value desc, name, id) as place from x"),
    "runs_query": (runs_query, f"with {RUNS} select id, queue, status from rn where status in ('queued', 'running') and team = 't1' and definition = 'def-1' and (contains(lower(id), 's1') or contains(lower(queue), 's1') or contains(lower(step), 's1') or contains(lower(definition), 's1') or contains(lower(session), 's1') or contains(lower(coalesce(invocation, '')), 's1'))"),
    "jobs_query": (jobs_query, f"with {RUNS} select id, status from rn where status = 'queued' and definition = 'def-2' and invocation is null"),
    "suspensions_query": (suspensions_query, f"with {RUNS} select id, step as name from rn where queue = '1-URGENT' and o_orderkey % 4 = 2 and o_orderkey % 3 = 1 and status in ('queued', 'complete')"),
    "root_tasks": (root_tasks, f"with {RUNS} select id from rn where status = 'queued' and o_orderkey % 3 <> 0 and definition = 'def-1' and queue in ('1-URGENT', '2-HIGH')"),
    "child_tasks": (child_tasks, f"with {RUNS} select id, status from rn where o_orderkey % 3 = 0 and o_orderkey - 1 = 5"),
    "artifacts_query": (artifacts_query, "select p_partkey::varchar as id, p_name as name from part where p_size <= 40 and p_brand = 'Brand#12' and (contains(lower(p_name), '1') or contains(lower(p_brand), '1') or contains(p_partkey::varchar, '1'))"),
    "directions_query": (directions_query, f"with {USES} select id || ':' || consumer || ':' || l_returnflag as id, us.id as \"from\", consumer as \"to\", l_returnflag as role, count(*) as \"count\" from us where consumer = 4 and l_returnflag = 'N' group by 1, 2, 3, 4 having count(*) >= 3"),
    "reviews_query": (reviews_query, "select p_partkey as id, p_type as gravity_center from part where p_size % 3 = 1 and p_size % 2 = 0 and p_brand = 'Brand#12'"),
    "patterns_query": (patterns_query, "select l_suppkey as id from lineitem where l_suppkey % 2 = 1 group by 1 having count(*) filter (l_returnflag = 'R') > 0 and count(*) filter (l_linenumber = 7) > 0 and count(*) % 3 = 0"),
    "recall_page": (recall_page, "select doc_id as id, 1.0::double as score from documents where lang = 'en' and contains(lower(text), 'the') order by doc_id % 97 desc, doc_id limit 20 offset 5"),
    "feed": (feed, "select o_orderkey as id from orders order by o_orderdate desc, o_orderkey limit 30"),
    "recoverable_runs": (recoverable_runs, f"with {RUNS} select id, status from rn where queue = '1-URGENT' and status in ('queued', 'running')"),
    "run_buckets": (run_buckets, f"with {RUNS} select case when o_orderkey % 7 = 0 then 'waiting' else status end as bucket, count(*) as runs from rn group by 1"),
    "miscentering": (miscentering, f"with {MIS} select concept, case when concept % 11 < 3 then 'behavior-light' when top is null then 'aligned' when tg >= 0.5 and tg - hg >= 0.25 and bt and bt::int + rt::int + ft::int + dt::int + xt::int + coalesce(ev = top, false)::int >= 2 then 'external-gravity' when rh >= 0.5 and 1 - bh >= 0.5 and concept % 9 >= 3 and (crossed or coalesce(ev <> home, false) or concept % 8 = 0) then 'boundary-drift' when concept % 4 <= concept % 5 and largest < 0.5 and pieces >= 2 and bd and (rd or fd or concept % 8 = 0 or concept % 10 = 0) then 'split-gravity' when bh < 0.5 then 'unclear' when led then 'usage-only' else 'aligned' end as outcome from z"),
    "evolutionary_pressures": (evolutionary_pressures, f"with {PROFILE}, st as (select id, 'surface-pressure' as pressure from pf where public_symbols >= 50 and utilization <= 0.25 and primary_share >= 0.8 union all select id, 'integration-pressure' from pf where fan_out >= 3 and dependency_reach >= 0.1 and outgoing_sites >= 50 union all select id, 'centralization-pressure' from pf where fan_in >= 3 and incoming_references >= 100 and destination_share >= 0.2 union all select id, 'internal-structure-pressure' from pf where module_depth - package_depth >= 10 and top_fan_in >= 20 and branch_heavy >= 3) select id, pressure, case when id % 23 + 5 < 10 then 'insufficient-history' when (pressure = 'integration-pressure' and (id % 10 >= 5 or id % 3 > 0)) or (pressure = 'surface-pressure' and ((id % 2 = 0 and id % 17 >= 10) or id % 13 >= 10)) or (pressure = 'centralization-pressure' and id % 4 = 0) or (pressure = 'internal-structure-pressure' and id % 5 = 0) then 'reinforced' else 'static-only' end as state from st"),
    "tensions": (tensions, "with s as (select s_suppkey as id from supplier where s_suppkey % 23 + 5 >= 10), k as (select id, case when id % 7 > 0 then id % 21 else 0 end as co from s) select id, 'static-leaf-temporal-coupling' as kind, greatest(id % 19, co) as commits from k where id % 3 = 1 and (id % 5 > 0 or co >= 10) union all select id, 'static-pressure-low-evolution', id % 23 + 5 from s where id % 4 > 0 and id % 6 <= 2 and id % 2 = 0 and id % 5 = 0 union all select l_suppkey, 'temporal-coupling-without-static-path ' || l_partkey || ' ' || (l_partkey + 1), l_linenumber from lineitem where l_quantity >= 45 and l_partkey % 3 > 0 and l_partkey % 4 > 0 and l_linenumber >= 5 and l_suppkey in (select id from s)"),
}
