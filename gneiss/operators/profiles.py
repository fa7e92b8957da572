"""Profiles, shapes, pressures and scores of packages, concepts and symbols, by the thresholds of the policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp01, ratio, ratio_or_null
from ..policy import DEFAULT, Policy
from .rules import first_of, signals


def consumption_shapes(packages: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(id, signals) of packages by who uses them.

    packages holds consumers and dependencies (counts), the primary consumer's reference_share,
    surface_share and references, whether any of its evidence is there (in_use), and whether the
    package depends on its primary consumer (returns).
    """
    some = F.col("consumers") > 0
    distributed = some & (F.col("consumers") >= policy.distributed_consumers) & (F.col("references") > 0) & (F.col("reference_share") < policy.distributed_share)
    rules = {
        "single-consumer": F.col("consumers") == 1,
        "concentrated-consumption": some & ((F.col("reference_share") >= policy.high_share) | (F.col("surface_share") >= policy.high_share)),
        "distributed-consumption": distributed,
        "high-fan-in": F.col("consumers") >= policy.high_fan_in,
        "high-fan-out": F.col("dependencies") >= policy.high_fan_out,
        "one-way-satellite": (F.col("consumers") == 1) & F.col("in_use") & ~F.col("returns"),
        "shared-hub": distributed & (F.col("consumers") >= policy.high_fan_in) & (F.col("consumers") > F.col("dependencies")),
    }
    return packages.select("id", signals(rules).alias("signals"))


def architectural_profile(packages: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(id, signals) from gravity (fan_in, fan_out, dependency_reach, dependent_reach) and surface
    (consumers, distribution, public_symbols, utilization, primary_share; null without a consumer)."""
    p, share = policy, F.col("primary_share")
    fan_in, fan_out = F.col("fan_in"), F.col("fan_out")
    rules = {
        "foundation-like": (fan_in >= p.foundation_fan_in) & (fan_out <= p.foundation_fan_out) & (F.col("dependent_reach") > F.col("dependency_reach")),
        "integration-like": (fan_in <= p.integration_fan_in) & (fan_out >= p.integration_fan_out) & (F.col("dependency_reach") > F.col("dependent_reach")),
        "shared-hub-like": (fan_in >= p.hub_fan_in) & (F.col("consumers") >= p.hub_consumers) & (F.col("distribution") >= p.hub_distribution),
        "leaf-like": (fan_in <= p.leaf_fan_in) & (fan_out >= 1) & (fan_out <= p.leaf_fan_out),
        "surface-heavy": (F.col("public_symbols") >= p.surface_symbols) & (F.col("utilization") <= p.surface_utilization),
        "narrowly-consumed": (F.col("consumers") >= 1) & (share >= p.high_share),
        "broadly-consumed": (F.col("consumers") >= p.broad_consumers) & (share < p.high_share),
    }
    return packages.select("id", signals(rules).alias("signals"))


def structural_pressures(packages: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(id, pressure, evidence) of the packages under a pressure, evidence as the numbers that decide.

    packages holds public_symbols, utilization, primary_share; fan_in, fan_out, dependency_reach,
    outgoing_sites, incoming_references, destination_share; package_depth, module_depth,
    top_fan_in (null without a source module) and branch_heavy (number of functions).
    """
    p = policy
    delta = F.col("module_depth") - F.col("package_depth")
    rules = {
        "surface-pressure": (
            (F.col("public_symbols") >= p.pressure_symbols) & (F.col("utilization") <= p.surface_utilization) & (F.col("primary_share") >= p.high_share),
            ("public_symbols", "utilization", "primary_share"),
        ),
        "integration-pressure": (
            (F.col("fan_out") >= p.pressure_fan) & (F.col("dependency_reach") >= p.pressure_reach) & (F.col("outgoing_sites") >= p.pressure_import_sites),
            ("fan_out", "dependency_reach", "outgoing_sites"),
        ),
        "centralization-pressure": (
            (F.col("fan_in") >= p.pressure_fan) & (F.col("incoming_references") >= p.pressure_references) & (F.col("destination_share") >= p.pressure_destination),
            ("fan_in", "incoming_references", "destination_share"),
        ),
        "internal-structure-pressure": (
            (delta >= p.pressure_depth) & (F.col("top_fan_in") >= p.pressure_top_fan_in) & (F.col("branch_heavy") >= p.pressure_functions),
            ("package_depth", "module_depth", "top_fan_in", "branch_heavy"),
        ),
    }
    out = None
    for name, (holds, evidence) in rules.items():
        shown = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.round(F.col(c).cast("double"), 6).cast("string")) for c in evidence])
        one = packages.filter(holds).select("id", F.lit(name).alias("pressure"), shown.alias("evidence"))
        out = one if out is None else out.union(one)
    return out


def boundary_shape(sites: Column, references: Column, symbols: Column, destination_share: Column, policy: Policy = DEFAULT) -> Column:
    """broad, concentrated, mixed, or null for a boundary under no pressure; references may be null."""
    volume = (sites >= policy.pressure_import_sites) | F.coalesce(references >= policy.pressure_references, F.lit(False))
    broad = volume & (symbols >= policy.boundary_symbols)
    narrow = (sites >= policy.boundary_sites) & (destination_share >= policy.boundary_share)
    return F.when(broad & narrow, "mixed").when(broad, "broad").when(narrow, "concentrated")


def pattern_strength(count: Column, minimum: Column, sources: Column, complete: Column, policy: Policy = DEFAULT) -> Column:
    """strong, moderate or limited, from a count against its minimum, the number of sources and whether all of it was read."""
    strong = count >= minimum * policy.strong_multiple
    return F.when(strong & (sources >= 2) & complete, "strong").when(((count >= minimum) & (sources >= 2)) | strong, "moderate").otherwise("limited")


def distribution_shapes(concepts: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(id, shapes) of concepts from packages, implementation_packages, reference_packages,
    reference_share, representations and representation_share (shares null without any)."""
    rules = {
        "cross-package": F.col("packages") > 1,
        "local": F.col("packages") <= 1,
        "implementation-split": F.col("implementation_packages") >= 2,
        "reference-distributed": (F.col("reference_packages") >= policy.reference_packages) & (F.col("reference_share") <= policy.reference_share),
        "representation-concentrated": (F.col("reference_packages") >= 2) & (F.col("representations") >= policy.representation_count) & (F.col("representation_share") >= policy.representation_share),
    }
    return concepts.select("id", signals(rules).alias("shapes"))


def concept_distribution(rows: DataFrame) -> DataFrame:
    """Representations and references (concept, package, representations, references) of each concept:
    totals, packages with any, the package with most (ties by name) and its share (null without any)."""
    single = rows.groupBy("concept", "package").agg(F.sum("representations").alias("representations"), F.sum("references").alias("references"))

    def lead(c: str) -> list[Column]:
        best = F.min(F.when(F.col(c) > 0, F.struct((-F.col(c)).alias("n"), F.col("package").alias("p"))))
        return [F.sum(c).alias(c), F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_packages"), best["p"].alias(f"{c}_primary"), ratio_or_null(-best["n"], F.sum(c)).alias(f"{c}_share")]

    return single.groupBy("concept").agg(F.count("*").alias("packages"), *lead("representations"), *lead("references"))


def locality_shares(consumers: DataFrame, by: list[str]) -> DataFrame:
    """Of each symbol's consumers (symbol, module, region or other `by`, import_sites, bindings), by region: modules, sites and bindings with their shares."""
    totals = consumers.groupBy("symbol").agg(F.countDistinct("module").alias("_m"), F.sum("import_sites").alias("_s"), F.sum("bindings").alias("_b"))
    rows = consumers.groupBy("symbol", *by).agg(F.countDistinct("module").alias("modules"), F.sum("import_sites").alias("import_sites"), F.sum("bindings").alias("bindings"))
    out = rows.join(totals, "symbol")
    shares = [ratio(F.col(c), F.col(t)).alias(n) for c, t, n in (("modules", "_m", "share"), ("import_sites", "_s", "import_site_share"), ("bindings", "_b", "binding_share"))]
    return out.select("symbol", *by, "modules", "import_sites", "bindings", *shares)


def symbol_distribution(symbols: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(symbol, distribution, placement) from consumers, directories, regions, top_share, significant
    (regions with a share that counts), home (the declaring region), top_region and relation.

    A region dominates with its share of consumer modules; without one, several regions that each
    count are a split. relation is how the declaring folder lies to the consumers' common one:
    same, ancestor, descendant or disjoint.
    """
    dominant = F.col("top_share") >= policy.dominant_share
    split = ~dominant & (F.col("significant") >= 2)
    shape = first_of(
        {
            "module-localized": F.col("consumers") == 1,
            "directory-localized": F.col("directories") == 1,
            "region-localized": F.col("regions") == 1,
            "multi-region": dominant | split,
        },
        "package-distributed",
    )
    rows = symbols.withColumn("distribution", shape)
    at_home = F.col("home") == F.col("top_region")
    placement = first_of(
        {
            "unclear": F.col("consumers") < policy.locality_consumers,
            "distributed": F.col("distribution") == "package-distributed",
            "split": split | ~dominant,
            "aligned": at_home & ((F.col("relation") == "same") | ((F.col("relation") == "descendant") & (F.col("significant") < 2))),
            "broader-than-consumers": F.col("relation") == "ancestor",
            "narrower-than-consumers": at_home & (F.col("relation") == "descendant"),
            "cross-directory": at_home,
        },
        "cross-region",
    )
    return rows.select("symbol", "distribution", placement.alias("placement"))


def fold_evidence(reference_share: Column, surface_share: Column, distribution: Column, one_way: Column, policy: Policy = DEFAULT) -> Column:
    """How much speaks for folding a package into its only consumer, 0 to 1."""
    narrow = clamp01((policy.narrow_distribution - distribution) / (policy.narrow_distribution - 1))
    # fixed values
    return 0.3 + 0.2 * reference_share + 0.2 * surface_share + 0.15 * narrow + F.when(one_way, 0.15).otherwise(0.0)


def preserve_evidence(consumers: Column, reference_share: Column, distribution: Column, policy: Policy = DEFAULT) -> Column:
    """How much speaks for keeping a shared boundary, 0 to 1."""
    # fixed values
    many = 0.4 * clamp01((consumers - 1) / (policy.high_fan_in - 1))
    return many + 0.35 * (1 - reference_share) + 0.25 * clamp01((distribution - 1) / (policy.narrow_distribution - 1))


def opportunities(packages: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(id, operation, evidence): fold a package with one consumer, preserve one with several, none of them dominant.

    packages is (id, consumers, reference_share, surface_share, distribution, one_way).
    """
    fold = packages.filter("consumers = 1").select("id", F.lit("fold-package").alias("operation"), fold_evidence(F.col("reference_share"), F.col("surface_share"), F.col("distribution"), F.col("one_way"), policy).alias("evidence"))
    keep = packages.filter((F.col("consumers") >= policy.broad_consumers) & (F.col("reference_share") <= policy.high_share))
    keep = keep.select("id", F.lit("preserve-shared-boundary").alias("operation"), preserve_evidence(F.col("consumers"), F.col("reference_share"), F.col("distribution"), policy).alias("evidence"))
    return fold.union(keep)


def internalize(symbols: DataFrame) -> DataFrame:
    """Public symbols (id, public, references, import_sites) that nothing outside refers to."""
    return symbols.filter(F.col("public") & (F.coalesce("references", F.lit(0)) + F.coalesce("import_sites", F.lit(0)) == 0)).select("id", F.lit("internalize-symbol").alias("operation"))


def propagation(paths: DataFrame) -> DataFrame:
    """(concept, direction) from (concept, home_layer, package, relation, layer), one row for each package with a role besides the home.

    unmeasured without a home layer; same-layer without such packages (package null) or where none
    lies above or below; disconnected where no package's relation is known and connected.
    """
    known = F.col("package").isNotNull() & ~F.coalesce(F.col("relation").isin("disconnected", "unmeasured"), F.lit(False))
    flags = paths.groupBy("concept").agg(
        F.first("home_layer").alias("h"), F.count("package").alias("n"), F.max(known).alias("c"),
        F.max(F.coalesce(known & (F.col("layer") > F.col("home_layer")), F.lit(False))).alias("up"), F.max(F.coalesce(known & (F.col("layer") < F.col("home_layer")), F.lit(False))).alias("down"),
    )
    rules = {"unmeasured": F.col("h").isNull(), "same-layer": F.col("n") == 0, "disconnected": ~F.col("c"), "bidirectional": F.col("up") & F.col("down"), "upstream": F.col("up"), "downstream": F.col("down")}
    return flags.select("concept", first_of(rules, "same-layer").alias("direction"))


def file_roles(files: DataFrame) -> DataFrame:
    """(file, role): junction, mixed, commons or unknown, the first that fits; null for none.

    files holds composition_root, scopes (null without evidence), local_groups, cross, package_wide, symbols and unresolved.
    """
    role = (
        F.when(F.col("composition_root"), "junction")
        .when(F.col("scopes").isNull(), None)
        .when(F.col("scopes") == "mixed-scope", "mixed")
        .when((F.col("local_groups") == 0) & (F.col("cross") + F.col("package_wide") > 0), "commons")
        .when((F.col("symbols") > 0) & (F.col("unresolved") == F.col("symbols")), "unknown")
    )
    return files.select("file", role.alias("role"))


def centers(rows: DataFrame, seed: DataFrame, minimum: int = 1, min_share: float = 0.0) -> DataFrame:
    """(concept, dimension, leader, value, share): the package that leads each dimension of a concept.

    rows is (concept, dimension, package, value), seed (concept, package). Zero never leads; equal
    values prefer the declaring package, then the lower name. A leader stays only with a total of at
    least `minimum` and a share of at least min_share.
    """
    single = rows.groupBy("concept", "dimension", "package").agg(F.sum("value").alias("v"))
    single = single.join(seed.select("concept", F.col("package").alias("_s")), "concept", "left")
    order = F.struct((-F.col("v")).alias("v"), (F.coalesce(F.col("package") != F.col("_s"), F.lit(True))).alias("s"), F.col("package").alias("p"))
    out = single.groupBy("concept", "dimension").agg(F.sum("v").alias("_t"), F.min(F.when(F.col("v") > 0, order)).alias("_b")).filter("_b is not null")
    out = out.select("concept", "dimension", F.col("_b.p").alias("leader"), (-F.col("_b.v")).alias("value"), ratio(-F.col("_b.v"), F.col("_t")).alias("share"), "_t")
    return out.filter((F.col("_t") >= minimum) & (F.col("share") >= min_share)).drop("_t")


def weighted_centers(shares: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(concept, package, gravity): shares (concept, family, package, share) summed with weights that add up to 1 over the families a concept has."""
    w = F.lit(None).cast("double")
    for family, value in weights.items():
        w = F.when(F.col("family") == family, value).otherwise(w)
    rows = shares.withColumn("w", w).filter("w is not null")
    present = rows.select("concept", "family", "w").distinct().groupBy("concept").agg(F.sum("w").alias("_t"))
    return rows.groupBy("concept", "package").agg(F.sum(F.col("w") * F.col("share")).alias("g")).join(present, "concept").select("concept", "package", (F.col("g") / F.col("_t")).alias("gravity"))


def workflow_rankings(runs: DataFrame, spend: DataFrame, workflows: DataFrame) -> DataFrame:
    """(kind, id, name, value, runs, place): the known workflows (id, name) by money spent and by the time their ended runs took.

    Spend (id, currency, amount) counts in USD only; runs (id, started_at, ended_at, workspace) count where they ended, not before
    they started, and lie in no workspace. Largest first, then by name and id.
    """
    took = F.col("ended_at") - F.col("started_at")
    elapsed = runs.filter((took >= 0) & F.col("workspace").isNull()).groupBy("id").agg(F.sum(took).cast("double").alias("value"), F.count("*").alias("runs"))
    cost = spend.filter("currency = 'USD'").groupBy("id").agg(F.sum("amount").cast("double").alias("value")).withColumn("runs", F.lit(None).cast("long"))
    both = elapsed.withColumn("kind", F.lit("elapsed")).unionByName(cost.withColumn("kind", F.lit("spend"))).join(workflows.select("id", "name"), "id")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("value"), "name", "id"))  # a row for each workflow
    return both.select("kind", "id", "name", "value", "runs", place.alias("place"))


#: Weights of the families that place a concept (fixed values).
GRAVITY = {"behavior": 0.6, "representation": 0.25, "reference": 0.15}


def miscentering(concepts: DataFrame, shares: DataFrame, crossings: DataFrame) -> DataFrame:
    """(concept, outcome): where the weight of a concept lies against the package that declares it.

    concepts is (concept, home, governing, strong, weak, foreign_behaviors, evolution_center or null,
    implementation_split, reference_distributed); shares (concept, family, package, share) with the
    families behavior, representation, reference and dependency; crossings (concept, package).

    behavior-light with too few governing behaviors; aligned without another package; then the first
    signal that has two kinds of evidence: external-gravity, boundary-drift, split-gravity; without
    one unclear where home leads no half of the behavior, usage-only where others lead the use, aligned.
    """
    # fixed values
    half, mismatch, piece, several = 0.5, 0.25, 0.2, 2
    c = concepts.select("concept", "home")
    places = weighted_centers(shares, GRAVITY)
    places = places.join(c, "concept").unionByName(c.join(places.select("concept", F.col("package").alias("home")), ["concept", "home"], "left_anti").select("concept", F.col("home").alias("package"), F.lit(0.0).alias("gravity"), "home"))
    away = F.col("package") != F.col("home")
    top = F.min(F.when(away, F.struct((-F.col("gravity")).alias("g"), F.col("package").alias("p"))))
    centers_ = places.groupBy("concept").agg(
        top["p"].alias("top"), (-top["g"]).alias("top_gravity"), F.coalesce(F.max(F.when(~away, F.col("gravity"))), F.lit(0.0)).alias("home_gravity"),
        F.max("gravity").alias("largest"), F.count(F.when(F.col("gravity") >= piece, 1)).alias("pieces"),
    )
    rows = shares.join(c, "concept").join(centers_.select("concept", "top"), "concept")
    flags = []
    for f in ("behavior", "representation", "reference", "dependency"):
        mine = F.col("family") == f
        flags += [
            F.coalesce(F.max(F.when(mine & (F.col("package") == F.col("home")), F.col("share"))), F.lit(0.0)).alias(f"{f}_home"),
            F.coalesce(F.max(F.when(mine & (F.col("package") == F.col("top")), F.col("share"))), F.lit(0.0)).alias(f"{f}_top"),
            F.coalesce((F.max(F.when(mine, F.col("share"))) < half) & (F.count(F.when(mine & (F.col("share") >= piece), 1)) >= several), F.lit(False)).alias(f"{f}_divided"),
        ]
    led = F.max(F.coalesce((F.col("package") != F.col("home")) & (F.col("share") >= half) & F.col("family").isin("reference", "dependency"), F.lit(False)))
    # Use counts only where the package is a center itself.
    known = rows.join(places.select("concept", "package", F.lit(True).alias("center")), ["concept", "package"], "left")
    use = known.filter("center").groupBy("concept").agg(led.alias("led"))
    facts = rows.groupBy("concept").agg(*flags)
    met = crossings.join(centers_.select("concept", "top"), "concept").groupBy("concept").agg(F.lit(True).alias("crossed"), F.max(F.col("package") == F.col("top")).alias("crossed_top"))
    x = concepts.join(centers_, "concept").join(facts, "concept", "left").join(use, "concept", "left").join(met, "concept", "left")
    numbers = [f"{f}_{k}" for f in ("behavior", "representation", "reference", "dependency") for k in ("home", "top")]
    x = x.na.fill(0.0, numbers).na.fill(False, ["led", "crossed", "crossed_top", *[f"{f}_divided" for f in ("behavior", "representation", "reference")]])

    def count(*parts: Column) -> Column:
        return sum((p.cast("int") for p in parts), F.lit(0))

    moved = F.coalesce(F.col("evolution_center") == F.col("top"), F.lit(False))
    support = count(*[F.col(f"{f}_top") >= half for f in ("behavior", "representation", "reference", "dependency")], F.col("crossed_top"), moved)
    external = (F.col("top_gravity") >= half) & (F.col("top_gravity") - F.col("home_gravity") >= mismatch) & (support >= several) & (F.col("behavior_top") >= half)
    foreign_center = F.coalesce(F.col("evolution_center") != F.col("home"), F.lit(False))
    drift = (F.col("representation_home") >= half) & (1 - F.col("behavior_home") >= half) & (F.col("foreign_behaviors") >= 3) & (count(F.col("crossed"), foreign_center, F.col("implementation_split")) + 1 >= several)
    parted = (F.col("weak") <= F.col("strong")) & (F.col("largest") < half) & (F.col("pieces") >= several) & F.col("behavior_divided")
    split = parted & (count(F.col("representation_divided"), F.col("reference_divided"), F.col("reference_distributed") | F.col("implementation_split")) + 1 >= several)
    rules = {
        "behavior-light": F.col("governing") < 3, "aligned": F.col("top").isNull(), "external-gravity": external, "boundary-drift": drift, "split-gravity": split,
        "unclear": F.col("behavior_home") < half, "usage-only": F.col("led"),
    }
    return x.select("concept", first_of(rules, "aligned").alias("outcome"))


def evolutionary_pressure(static: DataFrame, history: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(id, pressure, state) of static pressures (id, pressure): reinforced by history, static-only, or insufficient-history.

    history is (id, eligible, boundary_rate, direct_pairs, primary_commits, primary_combinations,
    seam_reinforced, hub_evidence): eligible commits, rate of those that cross a boundary, recurring
    partners with a direct path, commits shared with the primary consumer as a pair and as a whole set.
    """
    # fixed values
    rate, shared = 0.5, 10
    reinforced = (
        F.when(F.col("pressure") == "integration-pressure", (F.col("boundary_rate") >= rate) | (F.col("direct_pairs") > 0))
        .when(F.col("pressure") == "surface-pressure", (F.coalesce("primary_commits", F.lit(0)) >= shared) | (F.coalesce("primary_combinations", F.lit(0)) >= shared))
        .when(F.col("pressure") == "centralization-pressure", F.col("seam_reinforced"))
        .when(F.col("pressure") == "internal-structure-pressure", F.col("hub_evidence"))
    )
    state = F.when(F.coalesce("eligible", F.lit(0)) < policy.min_history, "insufficient-history").when(F.coalesce(reinforced, F.lit(False)), "reinforced").otherwise("static-only")
    return static.join(history, "id", "left").select("id", "pressure", state.alias("state"))


def tensions(packages: DataFrame, file_pairs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(id, kind, commits) where structure and history of a package (id, eligible, leaf, pressures, cross_rate,
    hotspots, recurring, partner_commits, combination_commits) pull apart.

    A leaf with a recurring partner or a set of two that recurs; pressures with a quiet history; and
    each pair of source files (id, left, right, static_path, context, commits) without a static path
    that often changes together. Packages with too little history have none.
    """
    # fixed values
    recurring, file_commits, quiet_rate = 10, 5, 0.25
    enough = packages.filter(F.col("eligible") >= policy.min_history)
    best = F.greatest(F.coalesce("partner_commits", F.lit(0)), F.coalesce("combination_commits", F.lit(0)))
    leaf = enough.filter(F.col("leaf") & ((F.col("recurring") > 0) | (F.coalesce("combination_commits", F.lit(0)) >= recurring))).select("id", F.lit("static-leaf-temporal-coupling").alias("kind"), best.cast("long").alias("commits"))
    quiet = enough.filter((F.col("pressures") > 0) & (F.col("cross_rate") <= quiet_rate) & (F.col("hotspots") == 0) & (F.col("recurring") == 0)).select("id", F.lit("static-pressure-low-evolution").alias("kind"), F.col("eligible").cast("long"))
    apart = file_pairs.filter((F.col("static_path") == "none") & (F.col("context") == "source-source") & (F.col("commits") >= file_commits))
    apart = apart.join(enough.select("id"), "id", "left_semi").select("id", F.concat_ws(" ", F.lit("temporal-coupling-without-static-path"), "left", "right").alias("kind"), F.col("commits").cast("long"))
    return leaf.union(quiet).union(apart)
