"""Where folders and responsibility disagree: unrelated regions in one folder, files far from their region, for all packages in one run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import directory_distance
from .graph import cut, weak_components


def _below(root: Column, path: Column, folder: bool) -> Column:
    """A path of a package as a path of the workspace; the folder `.` is the package's root itself."""
    top = (root == "") | (root == ".")
    out = F.when(top, path).otherwise(F.concat(root, F.lit("/"), path))
    return F.when(path == ".", F.when(root == "", ".").otherwise(root)).otherwise(out) if folder else out


def placed(modules: DataFrame, regions: DataFrame) -> DataFrame:
    """(package, file, folder, region, home) of modules (package, root, module, folder) and regions (package, module, region).

    home is the folder with most modules of the region, the first by name of several; both it and region are null where a module is unresolved.
    """
    m = modules.select("package", "root", "module", "folder").join(regions.select("package", "module", "region"), ["package", "module"], "left")
    m = cut(m.select("package", _below(F.col("root"), F.col("module"), False).alias("file"), _below(F.col("root"), F.col("folder"), True).alias("folder"), "region"))
    counts = m.filter("region is not null").groupBy("package", "region", "folder").agg(F.count("*").alias("n"))
    best = counts.groupBy("package", "region").agg(F.min(F.struct((-F.col("n")).alias("n"), "folder")).alias("b"))
    return cut(m.join(best.select("package", "region", F.col("b.folder").alias("home")), ["package", "region"], "left").select("package", "file", "folder", "region", "home"))


def files_apart(files: DataFrame) -> DataFrame:
    """(package, file, folder, region, home, distance) of the placed() files outside the folder that holds most of their region."""
    return files.filter("home <> folder").select("package", "file", "folder", "region", "home", directory_distance(F.col("folder"), F.col("home")).alias("distance"))


def related(files: DataFrame, relationships: DataFrame, pairs: DataFrame) -> DataFrame:
    """(package, a, b) of regions with a relationship (package, from, to), or with files that change together (left, right), once each, a < b."""
    at = files.filter("region is not null")
    left = at.select(F.col("file").alias("left"), "package", F.col("region").alias("from"))
    right = at.select(F.col("file").alias("right"), "package", F.col("region").alias("to"))
    changed = pairs.select("left", "right").distinct().join(left, "left").join(right, ["right", "package"]).filter("from <> to").select("package", "from", "to")
    both = relationships.select("package", "from", "to").union(changed).filter("from <> to")
    return both.select("package", F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).distinct()


def close_folders(files: DataFrame, links: DataFrame) -> DataFrame:
    """(package, folder, first_region, regions, files, apart, unresolved): the groups of related regions of each folder that has two or more.

    files are placed(), links related(). Regions of a folder are in one group if links lead from one to the other through regions of
    that folder: one component run over (package, folder, region) settles all folders. first_region is the first by name; regions and files are
    counts, apart the files outside their home, unresolved the folder's modules without a region.
    """
    here = cut(files.groupBy("package", "folder", "region").agg(F.count("*").alias("files"), F.count(F.when(F.col("home") != F.col("folder"), 1)).alias("apart")))
    known = here.filter("region is not null")
    node = F.concat_ws("\n", "package", "folder", "region")
    nodes = known.select("package", "folder", "region", node.alias("id"))
    a = nodes.select("package", "folder", F.col("region").alias("a"), F.col("id").alias("src"))
    b = nodes.select("package", "folder", F.col("region").alias("b"), F.col("id").alias("dst"))
    edges = cut(links.join(a, ["package", "a"]).join(b, ["package", "folder", "b"]).select("src", "dst"))
    component = weak_components(nodes.select("id"), edges).select("id", "component")
    groups = known.withColumn("id", node).join(component, "id").groupBy("package", "folder", "component").agg(F.min("region").alias("first_region"), F.count("*").alias("regions"), F.sum("files").alias("files"), F.sum("apart").alias("apart"))
    several = groups.groupBy("package", "folder").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    open_ = here.filter("region is null").select("package", "folder", F.col("files").alias("unresolved"))
    return groups.drop("component").join(several, ["package", "folder"]).join(open_, ["package", "folder"], "left").na.fill(0, ["unresolved"])
