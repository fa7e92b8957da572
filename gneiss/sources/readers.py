"""Readers: file inventories, history logs, manifests, transcripts, sharded datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "\x1e"  # record separator that the log format starts each commit with
FIELD = "\x1f"


def file_inventory(spark: SparkSession, root: str, ignore: list[tuple[str, bool]] = ()) -> DataFrame:
    """(path, bytes, modified) of all files below root, relative paths.

    ignore is a list of (regular expression, ignored); the last one that matches a path decides.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    base = root.split(":", 1)[-1].rstrip("/").lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", ""), f"^.*?{base}/", "")
    out = files.select(path.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    verdict = F.lit(False)
    for pattern, ignored in ignore:
        verdict = F.when(F.col("path").rlike(pattern), ignored).otherwise(verdict)
    return out.filter(~verdict)


def duplicate_paths(files: DataFrame) -> DataFrame:
    """Paths that are the same once their dots, slashes and case of separators are normal."""
    normal = F.regexp_replace(F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"(^|/)\./", "$1"), "/+", "/")
    return files.groupBy(normal.alias("path")).agg(F.count("*").alias("n")).filter("n > 1")


def workspaces(files: DataFrame, manifest: str, source: str) -> DataFrame:
    """(folder, kept, reason): folders with a manifest, kept if a source file (regular expression) lies below."""
    folders = files.filter(F.col("path").rlike(f"(^|/){manifest}$")).select(F.regexp_replace("path", f"/?{manifest}$", "").alias("folder")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    with_source = files.filter(F.col("path").rlike(source)).select(F.explode(above).alias("folder")).distinct().withColumn("kept", F.lit(True))
    out = folders.join(with_source, "folder", "left")
    return out.select("folder", F.coalesce("kept", F.lit(False)).alias("kept"), F.when(F.col("kept").isNull(), "no source files").alias("reason"))


def history_log(spark: SparkSession, path: str) -> DataFrame:
    """(hash, ts, author, path, previous_path, additions, deletions) of a change log.

    Each commit is a record separator, hash, unix time and author parted by unit separators, then
    lines "added<tab>deleted<tab>path". "-" counts are binary and null; "old => new" is a rename.
    """
    text = spark.read.option("lineSep", COMMIT).text(path).filter(F.trim("value") != "")
    lines = F.split("value", "\n")
    head = F.split(F.get(lines, F.lit(0)), FIELD)
    rows = text.select(F.get(head, F.lit(0)).alias("hash"), F.timestamp_seconds(F.get(head, F.lit(1)).cast("long")).alias("ts"), F.get(head, F.lit(2)).alias("author"), F.explode(F.slice(lines, 2, F.size(lines))).alias("l"))
    parts = F.split("l", "\t")
    name = F.get(parts, F.lit(2))
    moved = F.split(name, " => ")
    rename = F.size(moved) == 2
    return rows.filter(F.size(parts) == 3).select(
        "hash",
        "ts",
        "author",
        F.when(rename, F.get(moved, F.lit(1))).otherwise(name).alias("path"),
        F.when(rename, F.get(moved, F.lit(0))).alias("previous_path"),
        F.nullif(F.get(parts, F.lit(0)), F.lit("-")).cast("long").alias("additions"),
        F.nullif(F.get(parts, F.lit(1)), F.lit("-")).cast("long").alias("deletions"),
    )


def manifests(spark: SparkSession, path: str, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """(declared dependencies (file, package, kind, name, range), unreadable files) of JSON manifests."""
    fields = [T.StructField("name", T.StringType()), *[T.StructField(k, T.MapType(T.StringType(), T.StringType())) for k in kinds]]
    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value")
    parsed = raw.withColumn("m", F.when(F.expr("try_parse_json(value)").isNotNull(), F.from_json("value", T.StructType(fields))))
    out = None
    for k in kinds:
        one = parsed.select("file", F.col("m.name").alias("package"), F.lit(k).alias("kind"), F.explode(F.col(f"m.{k}")).alias("name", "range"))
        out = one if out is None else out.union(one)
    return out, parsed.filter("m is null").select("file")


def transcripts(spark: SparkSession, path: str, schema: T.StructType | str, marker: str, since: str | None = None) -> DataFrame:
    """Records of JSON-lines files; lines without the marker are skipped before parsing, malformed ones too."""
    reader = spark.read.option("modifiedAfter", since) if since else spark.read
    lines = reader.text(path).filter(F.contains("value", F.lit(marker)))
    valid = lines.filter(F.expr("try_parse_json(value)").isNotNull())
    return valid.select(F.from_json("value", schema).alias("r")).select("r.*")


def package_shards(spark: SparkSession, path: str, packages: list[str] | None = None) -> DataFrame:
    """A dataset sharded by package; only the shards asked for are read."""
    df = spark.read.parquet(path)
    return df.filter(F.col("package").isin(packages)) if packages is not None else df
