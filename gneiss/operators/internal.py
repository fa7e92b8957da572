"""The inside of packages: topology of their modules and regions of responsibility, for all packages in one run.

Modules are (package, module, kind, aggregator) with paths as names, edges (package, source, target) lie inside a package. Graph measures
run once over the union of all packages: no edge leaves one, so each keeps its own components, layers and blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import nearest_rank, ratio
from ..policy import DEFAULT, Policy
from .blocks import Appended, articulation
from .graph import cut, layers, simple, strong_components, weak_components

#: Roles in the order in which they are listed, and those of modules that connect others.
ROLES = ("isolated", "dependency-source", "dependency-sink", "high-fan-in", "high-fan-out", "aggregator", "bridge", "satellite", "cycle-member")
CONNECTORS = ("aggregator", "high-fan-in", "high-fan-out")
TECHNICAL_ROOTS = ("src", "source", "lib")


def folder_of(module: Column) -> Column:
    """The folder of a module path, `.` at the root."""
    return F.when(F.contains(module, F.lit("/")), F.regexp_replace(module, "/[^/]*$", "")).otherwise(".")


def region_of(folder: Column) -> Column:
    """The first segment of a folder, the second where the first is a technical root; `.` without one."""
    parts = F.split(folder, "/")
    at = F.get(parts, F.when(F.get(parts, F.lit(0)).isin(*TECHNICAL_ROOTS), 1).otherwise(0))
    return F.when(folder == ".", ".").otherwise(F.coalesce(at, F.lit(".")))


def above_regions(folder: Column) -> Column:
    """True for folders that hold regions rather than lie in one: the root and the technical roots."""
    return (folder == ".") | folder.isin(*TECHNICAL_ROOTS)


def _end(names: DataFrame, module: str, name: str) -> DataFrame:
    """(package, module, name): the number of each module, for edges that call it `module` at this end."""
    return names.select("package", F.col("module").alias(module), F.col("id").alias(name))


def topology(modules: DataFrame, edges: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(package, module, folder, region, fan_in, fan_out, context_fan_in, layer, cycle, roles, fan_in_cut, id) of the source modules of every package.

    Only edges between source modules count, without self imports and repeats; context_fan_in is the number of other
    modules that import one. layer is the longest way down to a module without dependencies, cycles as one. A
    cycle's name numbers those of its package by size, then by their first module; cycle is null outside. Fan is high from the
    larger of policy.min_fan and the nearest-rank p90 of the package's positive fans. roles is an array in the order of ROLES.
    id is a number of the module, of this run only: graphs are run on numbers, names are joined once.
    """
    all_ = modules.select("package", "module", "kind", F.coalesce("aggregator", F.lit(False)).alias("aggregator"))
    source = all_.filter("kind = 'source'")
    names = cut(source.select("package", "module").distinct().filter("package is not null and module is not null").withColumn("id", F.monotonically_increasing_id()))
    ids = names.select("id")
    e = edges.join(_end(names, "source", "src"), ["package", "source"]).join(_end(names, "target", "dst"), ["package", "target"])
    e = cut(simple(e.select("src", "dst")))
    others = all_.filter("kind is null or kind <> 'source'").select("package", F.col("module").alias("source"))
    context = edges.select("package", "source", "target").join(others, ["package", "source"], "left_semi").join(_end(names, "source", "src"), ["package", "source"], "left_anti")
    context = context.groupBy("package", "target").agg(F.countDistinct("source").alias("context_fan_in")).join(_end(names, "target", "id"), ["package", "target"]).select("id", "context_fan_in")
    components = cut(strong_components(ids, e))
    level = layers(components, e).select("id", "layer")
    ways = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.col("src").alias("to"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    near = e.select(F.inline(ways)).groupBy("id", "to").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    near = near.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.count("*").alias("neighbours"))
    bridge = articulation(e).withColumn("bridge", F.lit(True))
    measures = components.join(level, "id").join(near, "id", "left").join(bridge, "id", "left").join(context, "id", "left")
    out = source.drop("kind").join(names, ["package", "module"]).join(measures, "id")
    out = cut(out.na.fill(0, ["fan_in", "fan_out", "neighbours", "context_fan_in"]).na.fill(False, ["bridge"]))
    # One row for each cycle, numbered in its package.
    cycles = out.filter("size > 1").groupBy("package", "component").agg(F.count("*").alias("_n"), F.min("module").alias("_m"))
    number = F.row_number().over(Window.partitionBy("package").orderBy(F.desc("_n"), "_m"))
    cycles = cycles.select("package", "component", F.concat(F.lit("cycle-"), number).alias("cycle"))

    def high(c: str) -> Column:
        return F.greatest(F.lit(policy.min_fan), nearest_rank(c, 0.9))

    cuts = [out.filter(F.col(c) > 0).groupBy("package").agg(high(c).alias(f"{c}_cut")) for c in ("fan_in", "fan_out")]
    out = out.join(cycles, ["package", "component"], "left").join(cuts[0].join(cuts[1], "package", "full"), "package", "left")
    alone = F.col("neighbours") == 0
    has = {
        "isolated": alone,
        "dependency-source": ~alone & (F.col("fan_in") == 0),
        "dependency-sink": ~alone & (F.col("fan_out") == 0),
        "high-fan-in": F.coalesce(F.col("fan_in") >= F.col("fan_in_cut"), F.lit(False)),
        "high-fan-out": F.coalesce(F.col("fan_out") >= F.col("fan_out_cut"), F.lit(False)),
        "aggregator": F.col("aggregator"),
        "bridge": F.col("bridge"),
        "satellite": (F.col("neighbours") == 1) & ~F.col("aggregator"),
        "cycle-member": F.col("cycle").isNotNull(),
    }
    roles = F.array_compact(F.array(*[F.when(has[r], F.lit(r)) for r in ROLES]))
    folder = folder_of(F.col("module"))
    return out.select("package", "module", folder.alias("folder"), region_of(folder).alias("region"), "fan_in", "fan_out", "context_fan_in", "layer", "cycle", roles.alias("roles"), F.coalesce("fan_in_cut", F.lit(float("inf"))).alias("fan_in_cut"), "id")


def responsibilities(modules: DataFrame, symbols: DataFrame, localized: DataFrame) -> DataFrame:
    """(package, module, status, region, reason) of every module of a topology() table: the region of responsibility it belongs to.

    symbols is (package, source, target, symbol, declared): one row for each symbol that an edge between two of the modules carries, symbol
    null for edges without any, declared the module that declares it where that is not the target. localized is (package, symbol, concept) of the symbols whose use stays local.

    Units are cycles and single modules. In order: units are joined where one consumes a localized symbol of the other that is a
    concept, or lies in its folder below a region, unless a connector (aggregator, high fan) is at either end; modules still alone
    that bridge two or more groups through localized symbols stay unresolved; the other lone modules of a folder below a region are joined; a connector is attached to the one group it
    touches (through localized symbols, or else through any), a region of its own where it touches none, unresolved else. A region's name is a digest of its modules.
    Bridges are settled in the order of their names, as an unresolved module is no neighbour for those after it.
    """
    m = modules.select("package", "module", "folder", "cycle", "roles", "id")
    # A unit goes by the least number of its modules.
    units = m.filter("cycle is not null").groupBy("package", "cycle").agg(F.min("id").alias("unit"))
    connector = F.arrays_overlap("roles", F.array(*map(F.lit, CONNECTORS)))
    m = m.join(units, ["package", "cycle"], "left").withColumn("unit", F.coalesce("unit", "id"))
    m = cut(m.select("*", F.col("cycle").isNull().alias("single"), connector.alias("connector"), F.array_contains("roles", "bridge").alias("bridge")))
    # A symbol counts once on an edge; edges without a localized symbol stay, with a null one.
    names = m.select("package", "module", "id").distinct()
    local = localized.select("package", "symbol", F.coalesce("concept", F.lit(False)).alias("concept"), F.lit(True).alias("local"))
    s = symbols.filter("source <> target").select("package", "source", "target", "symbol", "declared").distinct().join(local, ["package", "symbol"], "left")
    s = s.join(_end(names, "source", "src"), ["package", "source"]).join(_end(names, "target", "dst"), ["package", "target"]).join(_end(names, "declared", "_d"), ["package", "declared"], "left")
    s = s.select("src", "dst", F.when(F.col("declared").isNull(), F.col("dst")).otherwise(F.col("_d")).alias("partner"), F.when(F.col("local"), F.col("symbol")).alias("symbol"), "concept")
    s = cut(s.distinct())
    a = m.select(F.col("id").alias("src"), F.col("unit").alias("src_unit"), F.col("folder").alias("src_folder"), F.col("connector").alias("src_connector"))
    b = m.select(F.col("id").alias("partner"), F.col("unit").alias("dst_unit"), F.col("folder").alias("dst_folder"), F.col("connector").alias("dst_connector"))
    flows = s.filter("symbol is not null").join(a, "src").join(b, "partner").filter("src_unit <> dst_unit and not src_connector and not dst_connector")
    ties = flows.filter(F.col("concept") | ((F.col("src_folder") == F.col("dst_folder")) & ~above_regions(F.col("src_folder"))))
    ties = cut(ties.select(F.col("src_unit").alias("src"), F.col("dst_unit").alias("dst")).distinct())
    units = m.select(F.col("unit").alias("id")).distinct()
    joined = ties.select(F.col("src").alias("unit")).union(ties.select("dst")).distinct()
    group = weak_components(units, ties).select(F.col("id").alias("unit"), F.col("component").alias("group"))
    m = cut(m.join(group, "unit").join(joined.withColumn("joined", F.lit(True)), "unit", "left").na.fill(False, ["joined"]))
    # Neighbours through edges, both ways: how many edges, and how many localized symbols.
    both = s.select("src", "dst", "symbol").union(s.select("dst", "src", "symbol"))
    near = both.groupBy(F.col("src").alias("id"), F.col("dst").alias("to")).agg(F.countDistinct("symbol").alias("symbols"))
    there = m.select(F.col("id").alias("to"), F.col("group").alias("to_group"), (~F.col("single") | ~F.col("connector")).alias("placeable"))
    near = cut(near.join(there, "to").filter("placeable").select("id", "to", "to_group", "symbols"))

    # Bridges in the order of their names: in a round those go whose earlier undecided neighbours are settled.
    lone = F.col("single") & ~F.col("joined") & ~F.col("connector")
    open_ = cut(m.filter(lone & F.col("bridge")).select("id", F.col("group").alias("own"), "module"))
    local_near = cut(near.filter("symbols > 0").join(open_.select("id", "own"), "id").filter("to_group <> own").select("id", "to", "to_group"))
    # Of two neighbours that are open both, the one with the later name waits.
    waits = near.filter("symbols > 0").join(open_.select("id", "module"), "id").join(open_.select(F.col("id").alias("to"), F.col("module").alias("_first")), "to")
    waits = cut(waits.filter("_first < module").select("id", "to"))
    open_ = open_.select("id")
    unresolved = Appended(open_.limit(0))
    while not open_.isEmpty():
        now = open_.join(waits, "id", "left_anti")
        groups = local_near.join(now, "id", "left_semi").join(unresolved.all().withColumnRenamed("id", "to"), "to", "left_anti")
        stuck = cut(groups.groupBy("id").agg(F.countDistinct("to_group").alias("n")).filter("n >= 2").select("id"))
        unresolved.add(stuck)
        open_ = cut(waits.select("id").distinct())
        waits = cut(waits.join(open_.withColumnRenamed("id", "to"), "to", "left_semi").select("id", "to"))
    bridges = cut(unresolved.all().withColumn("stuck", F.lit(True)))
    m = m.join(bridges, "id", "left").na.fill(False, ["stuck"])
    rest = lone & ~F.col("stuck") & ~above_regions(F.col("folder"))
    folders = m.filter(rest).groupBy("package", "folder").agg(F.min("group").alias("folder_group"))
    m = m.join(folders, ["package", "folder"], "left").withColumn("group", F.when(rest, F.col("folder_group")).otherwise(F.col("group")))
    m = cut(m.select("package", "module", "id", "group", "single", "connector", "stuck", "roles"))

    # Connectors: the groups they touch, by localized symbols where there are any.
    final = m.filter("not stuck").select(F.col("id").alias("to"), F.col("group").alias("at"))
    touched = near.join(m.filter("single and connector").select("id"), "id", "left_semi").join(final, "to")
    counts = touched.groupBy("id").agg(
        F.countDistinct(F.when(F.col("symbols") > 0, F.col("at"))).alias("local"), F.countDistinct("at").alias("any"), F.min(F.when(F.col("symbols") > 0, F.col("at"))).alias("local_at"), F.min("at").alias("any_at")
    )
    m = m.join(counts, "id", "left").na.fill(0, ["local", "any"])
    of = F.col("single") & F.col("connector")
    n = F.when(F.col("local") > 0, F.col("local")).otherwise(F.col("any"))
    status = F.when(F.col("stuck") | (of & (n > 1)), "unresolved").when(of & (n == 1), "attached").otherwise("assigned")
    place = F.when(status == "unresolved", None).when(status == "attached", F.when(F.col("local") > 0, F.col("local_at")).otherwise(F.col("any_at"))).otherwise(F.col("group"))
    why = F.when(F.col("stuck"), "bridge").when(F.array_contains("roles", "aggregator"), "aggregator").when(F.array_contains("roles", "high-fan-in"), "distributed-primitive").otherwise("wide-dependent")
    placed = cut(m.select("package", "module", status.alias("status"), place.alias("group"), F.when(status == "unresolved", why).alias("reason")))
    digest = F.concat(F.lit("responsibility:"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("module")), "\n"), 256), 1, 12))
    regions = placed.filter("group is not null").groupBy("group").agg(digest.alias("region"))  # a region is part of one package
    return placed.join(regions, "group", "left").select("package", "module", "status", "region", "reason")


def localized_symbols(symbols: DataFrame, modules: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(package, symbol) whose use stays local: not package-distributed, not split, and fewer consumers than the package's high fan-in.

    symbols as for responsibilities(), modules a topology() table. The shares of a symbol's consumer modules by region say
    what dominates; see profiles.symbol_distribution().
    """
    at = modules.select("package", F.col("module").alias("source"), "folder", "region", "fan_in_cut")
    used = symbols.filter("symbol is not null").select("package", "source", "symbol").distinct().join(at, ["package", "source"])
    shares = used.groupBy("package", "symbol", "region").agg(F.count("*").alias("n"))
    total = used.groupBy("package", "symbol").agg(F.count("*").alias("consumers"), F.countDistinct("folder").alias("folders"), F.first("fan_in_cut").alias("high"))
    rows = shares.join(total, ["package", "symbol"])
    share = ratio(F.col("n"), F.col("consumers"))
    tops = rows.groupBy("package", "symbol").agg(F.max(share).alias("top"), F.count("*").alias("regions"), F.count(F.when(share >= policy.significant_share, 1)).alias("significant"), F.first("consumers").alias("consumers"), F.first("folders").alias("folders"), F.first("high").alias("high"))
    dominant = F.col("top") >= policy.dominant_share
    split = ~dominant & (F.col("significant") >= 2)
    near = (F.col("consumers") == 1) | (F.col("folders") == 1) | (F.col("regions") == 1)
    distributed = ~near & ~dominant & ~split
    placed_split = (F.col("consumers") >= policy.locality_consumers) & ~distributed & (split | ~dominant)
    return tops.filter(~distributed & ~placed_split & (F.col("consumers") < F.col("high"))).select("package", "symbol")
