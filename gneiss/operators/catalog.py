"""Lookups, placements, observations and annotations that stand beside the large analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import model_id
from ..functions.stats import ratio
from ..policy import DEFAULT, Policy
from .deal import deal, large, tasks
from .graph import cut, simple


def catalog_ids(models: DataFrame, catalog: DataFrame, prefixes: list[str] = (), suffixes: list[str] = ()) -> DataFrame:
    """(id, match): the catalogue key of each model (id, model, vendor or null); null for none.

    Names are compared canonically. In order: a model that is a path by its whole key, vendor/model,
    a bare name that only one key ends in; then the same for the name without the prefixes and
    suffixes, each taken off once, where that changes it.
    """
    keys = catalog.select("key").distinct()
    by_path = keys.groupBy(model_id(F.col("key")).alias("k")).agg(F.max("key").alias("hit"))
    bare = keys.filter(F.contains("key", F.lit("/"))).groupBy(model_id(F.expr("substring(key, instr(key, '/') + 1)")).alias("k")).agg(F.count("*").alias("n"), F.max("key").alias("hit")).filter("n = 1").drop("n")
    stripped = F.col("model")
    for p in prefixes:
        stripped = F.when(F.startswith(stripped, F.lit(p)), F.substring(stripped, F.lit(len(p) + 1), F.length(stripped))).otherwise(stripped)
    for s in suffixes:
        stripped = F.when(F.endswith(stripped, F.lit(s)), F.substring(stripped, F.lit(1), F.length(stripped) - len(s))).otherwise(stripped)
    rows = models.withColumn("_s", F.when(stripped != F.col("model"), stripped))
    hits = []
    for i, name in enumerate(("model", "_s")):
        path = F.when(F.contains(name, F.lit("/")), model_id(F.col(name)))
        whole = F.when(F.col("vendor").isNotNull(), model_id(F.concat_ws("/", "vendor", name)))
        for j, (key, table) in enumerate(((path, by_path), (whole, by_path), (model_id(F.col(name)), bare))):
            label = f"_h{i}{j}"
            rows = rows.withColumn("_k", F.when(F.col(name).isNotNull(), key)).join(table.select(F.col("k").alias("_k"), F.col("hit").alias(label)), "_k", "left").drop("_k")
            hits.append(label)
    return rows.select("id", F.coalesce(*hits).alias("match"))


def placements(uses: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(level, place, home, away, label, toward) of places at several levels from uses (level, place, home_package, package, module).

    Modules are counted once for each package. A place departs toward the away package with a
    dominant share of its consumers, else fits where home has one, else is spread; ties of away
    packages go to the lower name. Each use is given once for every level it counts at.
    """
    by = uses.groupBy("level", "place", "home_package", "package").agg(F.countDistinct("module").alias("n"))
    away = F.col("package") != F.col("home_package")
    out = by.groupBy("level", "place").agg(
        F.coalesce(F.sum(F.when(~away, F.col("n"))), F.lit(0)).alias("home"), F.coalesce(F.sum(F.when(away, F.col("n"))), F.lit(0)).alias("away"), F.min(F.when(away, F.struct((-F.col("n")).alias("n"), F.col("package").alias("p")))).alias("_l")
    )
    total = F.col("home") + F.col("away")
    departs = F.coalesce(ratio(-F.col("_l.n"), total) >= policy.dominant_share, F.lit(False))
    label = F.when(departs, "departs").when(ratio(F.col("home"), total) >= policy.dominant_share, "fits").otherwise("spread")
    return out.select("level", "place", "home", "away", label.alias("label"), F.when(departs, F.col("_l.p")).alias("toward"))


def observation_hash(status: Column, body: Column) -> Column:
    """Hash of what a poll saw: JSON with its keys in order, else the text; a status that is no success counts too."""
    canonical = F.coalesce(F.to_json(F.try_parse_json(body)), body, F.lit(""))
    return F.sha2(F.when(status.between(200, 299), canonical).otherwise(F.concat_ws("\n", status.cast("string"), canonical)), 256)


def hops_through(edges: DataFrame, aggregators: DataFrame) -> DataFrame:
    """(src, dst, hops, via): distance of every linked pair, and whether some shortest path passes an aggregator (id) on its way."""
    e = cut(simple(edges))
    marked = aggregators.select(F.col("id").alias("via_id"), F.lit(True).alias("_m")).distinct()
    found = front = e.select("src", "dst", F.lit(1).alias("hops"), F.lit(False).alias("via"))
    hops = 1
    while True:
        hops += 1
        step = front.select("src", F.col("dst").alias("via_id"), "via").join(marked, "via_id", "left").join(e.select(F.col("src").alias("via_id"), "dst"), "via_id").filter("src <> dst")
        step = step.groupBy("src", "dst").agg(F.max(F.col("via") | F.coalesce("_m", F.lit(False))).alias("via")).join(found, ["src", "dst"], "left_anti")
        front = cut(step.select("src", "dst", F.lit(hops).alias("hops"), "via"))
        if front.isEmpty():
            return found
        found = cut(found.union(front))


def quota_windows(readings: DataFrame) -> DataFrame:
    """Windows from (account, span, hours, used_percent): the percentage kept within 0 and 100, the span as ms; hourly and custom spans bring their own length."""
    # fixed values
    hours = F.when(F.col("span") == "weekly", 168).when(F.col("span") == "monthly", 720).otherwise(F.col("hours"))
    return readings.select("account", "span", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("used_percent"))).alias("used_percent"), (hours * 3_600_000).cast("long").alias("duration"))


def facet_lineage(facets: DataFrame) -> DataFrame:
    """(id, ancestor, depth) of facets (id, parent): each facet, its parent, and so on up; cycles end where they close."""
    front = cut(facets.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).distinct())
    found, depth = front, 0
    up = facets.filter("parent is not null").select(F.col("id").alias("ancestor"), "parent").distinct()
    while True:
        depth += 1
        step = front.join(up, "ancestor").select("id", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        front = cut(step.join(found, ["id", "ancestor"], "left_anti"))
        if front.isEmpty():
            return found
        found = cut(found.union(front))


def timeline(numstat: DataFrame, names: DataFrame, rows: int | None = None) -> DataFrame:
    """Changes (hash, path, status, previous_path, additions, deletions), oldest first by (ts, hash, path), of two scans of one history.

    numstat is (hash, ts, path, additions, deletions), names (hash, path, status, previous_path). A
    path that only one of them has stays, with nulls for what the other says. With the number of rows of the larger
    scan, both and the sorted ranges are dealt by it (see deal()).
    """
    times = numstat.groupBy("hash").agg(F.min("ts").alias("ts"))
    stat = deal(numstat.drop("ts"), rows, "hash", "path")
    both = stat.join(deal(names, rows, "hash", "path"), ["hash", "path"], "full_outer")
    both = deal(both, rows, "hash").join(deal(times, rows, "hash"), "hash", "left").select("hash", "ts", "path", "status", "previous_path", "additions", "deletions")
    order = ["ts", "hash", "path"]
    return both.repartitionByRange(tasks(both, rows), *order).sortWithinPartitions(*order) if large(rows) else both.orderBy(*order)


def module_records(modules: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """One wide row for each module (id): every fact table (id, value) as a column, null where it has none, and what is missing as cautions."""
    out = modules.select("id")
    for name, df in facts.items():
        out = out.join(df.select("id", F.col("value").alias(name)), "id", "left")
    cautions = F.array_join(F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(f"no {n}")) for n in facts])), ", ")
    return out.withColumn("cautions", cautions)


def concept_graph(presence: DataFrame, overlaps: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(concept, kind, from, to): role edges from a concept to its packages, overlaps with other concepts, and dependencies among those packages.

    presence is (concept, package, role), overlaps (concept, other), dependencies (from, to).
    """
    roles = presence.select("concept", F.concat(F.lit("role:"), "role").alias("kind"), F.col("concept").cast("string").alias("from"), F.col("package").cast("string").alias("to"))
    others = overlaps.select("concept", F.lit("overlap").alias("kind"), F.col("concept").cast("string").alias("from"), F.col("other").cast("string").alias("to"))
    mine = presence.select("concept", "package").distinct()
    inside = dependencies.join(mine.withColumnRenamed("package", "from"), "from").join(mine.withColumnRenamed("package", "to"), ["concept", "to"])
    inside = inside.select("concept", F.lit("dependency").alias("kind"), F.col("from").cast("string").alias("from"), F.col("to").cast("string").alias("to"))
    return roles.union(others).union(inside).distinct()


def with_coverage(rows: DataFrame, packages: DataFrame) -> DataFrame:
    """Rows with the coverage of packages (id, analyzed): known, analyzed, and certainty, complete or lower-bound."""
    # one row
    one = packages.agg(F.count("*").alias("packages_known"), F.count(F.when(F.col("analyzed"), 1)).alias("packages_analyzed"))
    return rows.join(F.broadcast(one)).withColumn("certainty", F.when(F.col("packages_known") == F.col("packages_analyzed"), "complete").otherwise("lower-bound"))


def matrix_entities(df: DataFrame, row: str, column: str, entity: str, most: int | None = None) -> DataFrame:
    """Sparse cells with the number of their distinct entities and their ids, sorted; of large cells the first `most` where that is given."""
    ids = F.array_sort(F.collect_set(entity))
    return df.groupBy(F.col(row).alias("row"), F.col(column).alias("column")).agg(F.countDistinct(entity).alias("value"), (F.slice(ids, 1, most) if most else ids).alias("entities"))


def consumer_sites(refs: DataFrame, imports: DataFrame) -> DataFrame:
    """(supplier, consumer, references, import_sites) over the consumers that references or imports (supplier, consumer) name."""
    a = refs.groupBy("supplier", "consumer").agg(F.count("*").alias("references"))
    b = imports.groupBy("supplier", "consumer").agg(F.count("*").alias("import_sites"))
    return a.join(b, ["supplier", "consumer"], "full_outer").na.fill(0, ["references", "import_sites"])
