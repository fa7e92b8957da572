"""Structure of packages and modules: owners, boundaries, foundations, seams, chains, roles and pressures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ancestors
from ..functions.stats import nearest_rank, ratio
from ..policy import DEFAULT, Policy
from . import graph
from .deal import deal
from .rules import signals


def longest_prefix_owner(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, owner): the owner with the longest root that is the path or a folder above it; null for none.

    Joined on the path's own prefixes, so no path meets a root that is not above it.
    """
    own = paths.select("path").distinct()
    rows = own.select("path", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")), F.array("path"))).alias("root")).distinct()
    best = F.max(F.struct(F.char_length("root").alias("n"), "owner")).alias("b")
    found = rows.join(roots.select("root", "owner"), "root").groupBy("path").agg(best)
    return own.join(found, "path", "left").select("path", F.col("b.owner").alias("owner"))


def boundary(refs: DataFrame, consumer: str, supplier: str, site: str, symbol: str, rows: int | None = None) -> DataFrame:
    """Of each ordered pair of owners: sites, references, symbols, and the largest contributor's share on both sides.

    Sites and symbols of a pair are counted in rows of their own, dealt by the number of rows where that is given (see deal()).
    """
    keys = [consumer, supplier]
    refs = refs.select(*keys, site, symbol)
    by_site = deal(refs, rows, *keys, site).groupBy(*keys, site).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("_s"), F.sum("n").alias("references"), F.count(site).alias("sites"))
    by_symbol = deal(refs, rows, *keys, symbol).groupBy(*keys, symbol).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("_y"), F.count(symbol).alias("symbols"))
    out = by_site.join(by_symbol, keys)
    return out.select(*keys, "sites", "references", "symbols", ratio(F.col("_s"), F.col("references")).alias("site_share"), ratio(F.col("_y"), F.col("references")).alias("symbol_share"))


def through_paths(edges: DataFrame) -> DataFrame:
    """(id, paths): ways through each node whose ends differ, as fan-in x fan-out less those that return."""
    e = graph.simple(edges)
    back = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_r"))
    fan_in, fan_out = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_i")), e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_o"))
    return fan_in.join(fan_out, "id").join(back, "id", "left").select("id", (F.col("_i") * F.col("_o") - F.coalesce("_r", F.lit(0))).alias("paths"))


def subgraph(nodes: DataFrame, edges: DataFrame, least: int = 1, connected_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and weighted edges (src, dst, weight) among them of at least a weight; isolated nodes go on demand."""
    ids = nodes.select("id")
    e = edges.filter(F.col("weight") >= least).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")
    if connected_only:
        nodes = nodes.join(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")
    return nodes, e


def foundations(reach: DataFrame, uses: DataFrame, attenuation: float = 0.5, saturation: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(members, groups) of dependencies that two or more consumers reach.

    reach is (src, dst, hops), uses (src, dst, uses). A member's weight is attenuation ^ (hops - 1) x
    (1 + min(saturation, 1 - e^(-uses / 4))). Groups are dependencies with one and the same set of
    consumers, told apart by a hash of the set, so sets are never gathered.
    """
    shared = reach.groupBy("dst").agg(F.count("*").alias("n")).filter("n >= 2").select("dst")
    rows = reach.join(shared, "dst").join(uses, ["src", "dst"], "left")
    used = F.least(F.lit(saturation), 1 - F.exp(-F.coalesce("uses", F.lit(0)) / 4))
    members = rows.select("dst", "src", (F.pow(F.lit(attenuation), F.col("hops") - 1) * (1 + used)).alias("weight"))
    sets = members.groupBy("dst").agg(F.count("*").alias("consumers"), F.expr("bit_xor(xxhash64(src))").alias("_a"), F.expr("bit_xor(xxhash64(7, src))").alias("_b"))
    groups = sets.groupBy("consumers", "_a", "_b").agg(F.min("dst").alias("foundation"), F.count("*").alias("dependencies"))
    return members, groups.select("foundation", "consumers", "dependencies")


def fan_cutoffs(modules: DataFrame, package: str, value: str, policy: Policy = DEFAULT) -> DataFrame:
    """Per package the larger of the least fan and the nearest-rank p90 of positive values; infinity without any."""
    cut = modules.filter(F.col(value) > 0).groupBy(package).agg(F.greatest(F.lit(policy.min_fan), nearest_rank(value, 0.9)).cast("double").alias("cutoff"))
    return modules.select(package).distinct().join(cut, package, "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(float("inf"))))


def seams(structure: DataFrame, weights: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Edges of paths.edge_structure() that sever enough pairs, or part a component into large enough sides.

    weights is (src, dst, betweenness). Ordered by severed pairs, betweenness, then by their ends.
    """
    large = F.col("bridge") & (F.least("src_side", "dst_side") >= policy.seam_region)
    rows = structure.filter((F.col("severed") >= policy.seam_pairs) | large).join(weights, ["src", "dst"])
    return rows.orderBy(F.desc("severed"), F.desc("betweenness"), "src", "dst")


def resolve_references(refs: DataFrame, artifacts: DataFrame, contents: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, status, content, path) of references (id, artifact, content or null, path or null).

    artifacts is (artifact, current), contents (content, artifact, usable, root, entry), where root
    is the path the content opens at and entry whether that has to be a file, entries (content, path, type).
    The first that applies: artifact-missing, content-missing, content-mismatch, content-unusable,
    path-invalid, entry-missing, else available. Without a content asked for, the artifact's current
    one counts if it is usable.
    """
    a = artifacts.select("artifact", "current", F.lit(True).alias("_a"))
    c = contents.select(F.col("content").alias("_id"), F.col("artifact").alias("_owner"), F.col("usable").alias("_u"), "root", F.col("entry").alias("_e"))
    rows = refs.withColumnRenamed("content", "_asked").withColumnRenamed("path", "_path").join(a, "artifact", "left")
    rows = rows.withColumn("_id", F.coalesce("_asked", "current")).join(c, "_id", "left")
    asked, there = F.col("_asked").isNotNull(), F.col("_owner").isNotNull()
    content = F.when(asked | F.col("_u"), F.when(there, F.col("_id")))
    rows = rows.withColumn("_content", content).withColumn("path", F.coalesce("_path", F.when(F.col("_content").isNotNull(), F.col("root"))))
    rows = rows.join(entries.select(F.col("content").alias("_content"), "path", "type"), ["_content", "path"], "left")
    invalid = F.col("path").isNotNull() & ((F.col("path") == "") | F.col("path").rlike(r"^/|\\|(^|/)\.{1,2}(/|$)|//|/$|\x00"))
    status = (
        F.when(F.col("_a").isNull(), "artifact-missing")
        .when(asked & ~there, "content-missing")
        .when(asked & (F.col("_owner") != F.col("artifact")), "content-mismatch")
        .when(asked & ~F.col("_u"), "content-unusable")
        .when(invalid, "path-invalid")
        .when(F.col("_path").isNull() & F.col("_content").isNotNull() & F.coalesce("_e", F.lit(False)) & ~F.coalesce(F.col("type") == "file", F.lit(False)), "entry-missing")
        .otherwise("available")
    )
    good = status == "available"
    return rows.select("id", status.alias("status"), F.when(good, F.col("_content")).alias("content"), F.when(good, F.col("path")).alias("path"))


def broken_references(refs: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    return refs.join(targets.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def retention_gaps(removed: DataFrame, scope: str, position: str) -> DataFrame:
    """Removed rows of each scope and the last of their positions."""
    return removed.groupBy(scope).agg(F.count("*").alias("removed"), F.max(position).alias("through"))


def compaction_floor(log: DataFrame, consumers: DataFrame, position: str, ts: str, cutoff: Column, seen_after: Column) -> DataFrame:
    """One row: the smallest position of recent consumers and of young rows."""
    slow = consumers.filter(F.col("seen_at") >= seen_after).agg(F.min("position").alias("_s"))
    young = log.agg(F.min(F.when(F.col(ts) >= cutoff, F.col(position))).alias("_y"), F.max(position).alias("_h"))
    return slow.join(young).select(F.least(F.coalesce("_s", "_h"), F.coalesce(F.col("_y") - 1, F.col("_h"))).alias("floor"))


def context_size(messages: DataFrame, session: str, order: str, usage: str, estimate: Column) -> DataFrame:
    """Last reported usage of a session, else the sum of estimates."""
    last = F.max(F.when(F.col(usage).isNotNull(), F.struct(order, usage)))
    return messages.groupBy(session).agg(F.coalesce(last[usage], F.sum(estimate)).alias("tokens"))


def merged_timeline(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Union of (at as text, line) tables by time; a bad time counts as the epoch, ties keep the order of sources."""
    out = None
    for i, (name, df) in enumerate(sources):
        at = F.coalesce(F.col("at").try_cast("timestamp"), F.timestamp_seconds(F.lit(0)))
        one = df.select(at.alias("at"), F.lit(i).alias("_i"), F.lit(name).alias("source"), "line")
        out = one if out is None else out.union(one)
    return out.orderBy("at", "_i", "line").drop("_i")


def next_due(schedules: DataFrame, key: str, state: str, due: str) -> DataFrame:
    """The waiting schedule of each key that is due first; one without a due time comes after all others."""
    rest = [c for c in schedules.columns if c not in (key, state, due)]
    first = F.min(F.struct(F.col(due).isNull().alias("_late"), due, *rest)).alias("r")
    return schedules.filter(F.col(state) == "waiting").groupBy(key).agg(first).select(key, "r.*").drop("_late")


def overlap_assessment(dimensions: dict[str, Column], structural: list[str]) -> Column:
    """Dimensions that agree, if there are two or more and a structural one is among them; else empty."""
    agreed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in dimensions.items()]))
    return F.when((F.size(agreed) >= 2) & F.arrays_overlap(agreed, F.array(*map(F.lit, structural))), F.array_join(agreed, ",")).otherwise("")


def import_usage(imports: DataFrame) -> DataFrame:
    """(package, dependency, runtime, type_only): symbols of each import table (package, dependency, symbol, type_only)."""
    rows = imports.groupBy("package", "dependency", "symbol").agg(F.min("type_only").alias("t"))
    return rows.groupBy("package", "dependency").agg(F.count(F.when(~F.col("t"), 1)).alias("runtime"), F.count(F.when(F.col("t"), 1)).alias("type_only"))


def lock_lookup(requests: DataFrame, lock: DataFrame) -> DataFrame:
    """Resolve (locator path, name) against lock entries (at, name, version): the deepest folder above wins."""
    parts = F.split("locator", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = requests.withColumn("at", F.explode(F.array_distinct(above)))
    best = F.max(F.struct(F.char_length("at").alias("n"), "version")).alias("b")
    found = rows.join(lock, ["at", "name"]).groupBy("locator", "name").agg(best).select("locator", "name", "b.version")
    return requests.join(found, ["locator", "name"], "left")


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
