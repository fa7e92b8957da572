"""Dependency graphs of repositories from their manifests and lock files, all repositories in one run, with a list of what could not be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: The kinds of declared dependencies, the lock format that is read, the id of a repository's own package.
KINDS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
LOCK_VERSION, WORKSPACE, ROOT_ID = 1, "workspace:", "workspace-root:"
_RANGES = ", ".join(f"{k} map<string, variant>" for k in KINDS)
_PEERS = "optionalPeers array<string>, peerDependenciesMeta map<string, variant>"


def plain_json(text: Column) -> Column:
    """JSON without the comments and closing commas that lock files may have; strings stay as they are."""
    string = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'
    bare = F.regexp_replace(text, string + r"|//[^\n]*+|/\*(?s:.*?)\*/", "$1")
    return F.regexp_replace(bare, string + r"|,(?=\s*+[}\]])", "$1")


def _kind_of(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _flag(v: Column) -> Column:
    said = F.when(_kind_of(v) == "OBJECT", F.try_variant_get(v, "$.optional", "variant"))
    return F.coalesce(F.when(_kind_of(said) == "BOOLEAN", F.try_variant_get(said, "$", "boolean")), F.lit(False))


def _declared(meta: Column) -> Column:
    """(kind, name, range, optional) of the text ranges of a parsed manifest or lock entry."""
    peers = F.coalesce(meta["optionalPeers"], F.array().cast("array<string>"))

    def rows(kind: str) -> Column:
        entries = F.coalesce(F.map_entries(meta[kind]), F.expr("cast(array() as array<struct<key: string, value: variant>>)"))
        named = F.filter(entries, lambda e: _kind_of(e["value"]) == "STRING")

        def one(e: Column) -> Column:
            said = F.coalesce(_flag(F.element_at(meta["peerDependenciesMeta"], e["key"])), F.lit(False))
            optional = F.lit(kind == "optionalDependencies") if kind != "peerDependencies" else F.array_contains(peers, e["key"]) | said
            return F.struct(F.lit(kind).alias("kind"), e["key"].alias("name"), F.try_variant_get(e["value"], "$", "string").alias("range"), optional.alias("optional"))

        return F.transform(named, one)

    return F.concat(*[rows(k) for k in KINDS])


def _text(struct: Column, name: str) -> Column:
    v = struct[name]
    return F.when(_kind_of(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _issue(df: DataFrame, issue: str, subject: str | Column) -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    return df.select("root", F.lit(issue).alias("issue"), subject.cast("string").alias("subject"))


def packages(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages (root, path, role, id, name, version, declared) of manifests (root, path, role, manifest), and issues.

    A manifest that is no JSON object is the issue unreadable-manifest. Without a name a package is called like the last
    folder of its root. role is root or workspace.
    """
    m = F.from_json("manifest", f"name variant, version variant, {_RANGES}, {_PEERS}")
    good = F.coalesce(_kind_of(F.try_parse_json("manifest")) == "OBJECT", F.lit(False))
    rows = manifests.select("root", "path", "role", F.when(good, m).alias("m"))
    name = F.coalesce(_text(F.col("m"), "name"), F.regexp_extract(F.regexp_replace("root", "/+$", ""), "[^/]*$", 0))
    out = rows.filter("m is not null").select("root", "path", "role", F.when(F.col("role") == "root", ROOT_ID).otherwise(name).alias("id"), name.alias("name"), _text(F.col("m"), "version").alias("version"), _declared(F.col("m")).alias("declared"))
    return out, _issue(rows.filter("m is null"), "unreadable-manifest", "path")


def _ancestors(locator: Column) -> Column:
    """The places to look below, nearest first: the locator, then what is above it (a scope alone is no place), then the top."""
    parts = F.split(locator, "/")
    n = F.size(parts)
    up = F.filter(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: (k == n) | ~F.startswith(F.get(parts, k - 1), F.lit("@")))
    places = F.transform(up, lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    return F.concat(F.when(locator == "", F.array().cast("array<string>")).otherwise(places), F.array(F.lit("")))


def dependency_graph(manifests: DataFrame, locks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, issues) of every repository.

    manifests is (root, path, role, manifest), one row a package, locks (root, lock), texts; a null lock is none.
    nodes: (root, id, kind, name, version, locator), packages as workspace, lock entries as external. edges: (root, source,
    kind, name, range, optional, target), one row a declaration; target null where none is confirmed. issues: (root, issue, subject).

    * A declaration of a package or entry is resolved at the nearest place above its locator that has the name.
    * Those of packages hold only if the lock says the same range for a package of the same name, else they are manifest-differs
      (with manifest-identity for the package). Ranges of workspace: that stay open go to the package of that name
      (of several, the one with the last path).
    * Entries are left out as unreadable-entry (no array that starts with a text), unsupported-descriptor (no version) or workspace-identity
      (another name at the path), entries of packages that are not there without an issue; missing-metadata ones stay without declarations.
      Other issues: no-lock, unsupported-lock, unresolved (how many).

    Repositories meet nowhere: every join carries the root. An entry's places to look are as many as its locator is deep.
    """
    inventory, unread = packages(manifests)
    inventory = cut(inventory)
    text = plain_json(F.col("lock"))
    lock = locks.filter("lock is not null").select("root", F.from_json(text, "lockfileVersion variant, workspaces map<string, string>, packages map<string, string>").alias("l"), F.try_parse_json(text).alias("v"))
    fit = (_kind_of(F.col("v")) == "OBJECT") & (F.try_variant_get("v", "$.lockfileVersion", "double") == LOCK_VERSION) & F.col("l.packages").isNotNull() & F.col("l.workspaces").isNotNull()
    lock = cut(lock.select("root", F.coalesce(fit, F.lit(False)).alias("fit"), F.when(fit, F.col("l.packages")).alias("packages"), F.when(fit, F.col("l.workspaces")).alias("workspaces")))
    roots = inventory.select("root").union(manifests.select("root")).distinct()
    issues = [unread, _issue(roots.join(lock, "root", "left_anti"), "no-lock", F.lit("")), _issue(lock.filter("not fit"), "unsupported-lock", F.lit(""))]
    lock = lock.filter("fit")

    # Lock entries.
    e = lock.select("root", F.explode("packages").alias("locator", "raw")).withColumn("v", F.try_parse_json("raw"))
    first = F.when(_kind_of(F.col("v")) == "ARRAY", F.try_variant_get("v", "$[0]", "variant"))
    e = e.withColumn("descriptor", F.when(_kind_of(first) == "STRING", F.try_variant_get(first, "$", "string")))
    at = F.locate("@", "descriptor", 2)
    third = F.try_variant_get("v", "$[2]", "variant")
    meta = F.when(_kind_of(third) == "OBJECT", F.from_json(F.to_json(third), f"{_RANGES}, {_PEERS}"))
    e = cut(
        e.select("root", "locator", "descriptor", at.alias("at"), F.when(at > 0, F.substring("descriptor", F.lit(1), at - 1)).alias("name"), F.when(at > 0, F.substring("descriptor", at + 1, F.char_length("descriptor"))).alias("version"), meta.isNull().alias("bare"), _declared(meta).alias("declared"))
    )
    issues += [_issue(e.filter("descriptor is null"), "unreadable-entry", "locator"), _issue(e.filter("at = 0"), "unsupported-descriptor", "locator")]
    local = F.startswith("version", F.lit(WORKSPACE))
    at_path = inventory.select("root", F.col("path").alias("_path"), F.col("name").alias("_name"), F.col("id").alias("_id"), F.col("version").alias("_version"))
    inside = e.filter((F.col("at") > 0) & local).withColumn("_path", F.substring("version", F.lit(len(WORKSPACE) + 1), F.char_length("version"))).join(at_path, ["root", "_path"])
    issues.append(_issue(inside.filter("name <> _name"), "workspace-identity", F.col("_path")))
    outside = e.filter((F.col("at") > 0) & ~local)
    issues.append(_issue(outside.filter("bare"), "missing-metadata", "locator"))
    external = outside.select("root", F.concat(F.lit("lock:"), "locator").alias("id"), "locator", "name", "version", F.when(~F.col("bare"), F.col("declared")).alias("declared"))
    targets = inside.filter("name = _name").select("root", "locator", F.col("_id").alias("target")).union(external.select("root", "locator", F.col("id")))

    # Declarations of packages as the lock has them.
    own = inventory.select("root", "id", "path", "role", F.col("name").alias("package"), F.explode_outer("declared").alias("d"))
    w = lock.select("root", F.explode("workspaces").alias("path", "saved")).withColumn("s", F.from_json("saved", f"name variant, {_RANGES}, {_PEERS}"))
    w = cut(w.select("root", "path", _text(F.col("s"), "name").alias("saved_name"), _declared(F.col("s")).alias("saved")))
    known = lock.select("root", F.lit(True).alias("locked"))
    named = inventory.select("root", "path", "role", "name").join(known, "root").join(w, ["root", "path"], "left")
    other = cut(named.filter((F.col("role") == "workspace") & ~F.coalesce(F.col("saved_name") == F.col("name"), F.lit(False))).select("root", "path"))
    issues.append(_issue(other, "manifest-identity", "path"))
    ranges = w.select("root", "path", F.explode("saved").alias("x")).select("root", "path", F.col("x.kind").alias("kind"), F.col("x.name").alias("name"), F.col("x.range").alias("_saved"))
    own = own.filter("d is not null").select("root", "id", "path", "role", "package", "d.*").join(known, "root", "left").join(ranges, ["root", "path", "kind", "name"], "left").join(other.withColumn("_other", F.lit(True)), ["root", "path"], "left")
    differs = F.col("locked").isNotNull() & (F.col("_other").isNotNull() | ~F.coalesce(F.col("_saved") == F.col("range"), F.lit(False)))
    own = own.select("root", F.col("id").alias("source"), F.when(F.col("role") == "root", "").otherwise(F.col("package")).alias("locator"), "kind", "name", "range", "optional", differs.alias("differs"), "package")
    issues.append(_issue(own.filter("differs"), "manifest-differs", F.concat("package", F.lit(" "), "kind", F.lit("."), "name")))

    # One row for each place to look, the nearest that has the name.
    theirs = external.select("root", F.col("id").alias("source"), "locator", F.explode("declared").alias("d")).select("root", "source", "locator", "d.*").withColumn("differs", F.lit(False))
    asked = cut(own.drop("package").unionByName(theirs))
    places = asked.filter("not differs").select("root", "source", "kind", "name", F.posexplode(_ancestors(F.col("locator"))).alias("far", "place"))
    found = places.withColumn("locator", F.concat("place", "name")).join(targets, ["root", "locator"]).groupBy("root", "source", "kind", "name").agg(F.min_by("target", "far").alias("found"))
    by_name = inventory.groupBy("root", "name").agg(F.max_by("id", "path").alias("by_name"))
    edges = asked.join(found, ["root", "source", "kind", "name"], "left").join(by_name, ["root", "name"], "left")
    edges = cut(edges.select("root", "source", "kind", "name", "range", "optional", F.coalesce("found", F.when(F.startswith("range", F.lit(WORKSPACE)), F.col("by_name"))).alias("target")))
    issues.append(edges.filter("target is null").groupBy("root").agg(F.count("*").alias("n")).select("root", F.lit("unresolved").alias("issue"), F.col("n").cast("string").alias("subject")))
    none = F.lit(None).cast("string")
    nodes = inventory.select("root", "id", F.lit("workspace").alias("kind"), "name", "version", none.alias("locator")).union(external.select("root", "id", F.lit("external"), "name", "version", "locator"))
    out = issues[0]
    for more in issues[1:]:
        out = out.union(more)
    return nodes, edges, out
