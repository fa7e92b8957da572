"""History scans in git's own formats: NUL-separated logs with numbers or statuses, file lists, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What --format starts each commit with, and what -z parts fields by.
COMMIT, NUL = "\x01", "\x00"
#: A count entry: an inline path, or none and then the old and the new name as fields of their own.
NUMSTAT = r"\x00\n?(\d+|-)\t(\d+|-)\t(?:([^\x00]+)|(?:\x00([^\x00]*))?(?:\x00([^\x00]*))?)(?=\x00|$)"
#: A status entry; renames and copies have two names.
STATUS = r"\x00\n*(?:([RC])[^\x00]*\x00([^\x00]*)\x00([^\x00]*)|([^\x00\nRC])[^\x00]*\x00([^\x00]*))(?=\x00|$)"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """One row a commit with its place in the log; Spark reads a record whole wherever a file is split."""
    rows = spark.read.option("lineSep", COMMIT).text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return rows.select("value", F.struct("_f", "_b", "_i").alias("place"))


def _entries(record: Column, pattern: str) -> Column:
    return F.regexp_extract_all(record, F.lit(pattern), F.lit(0))


def _part(entry: str | Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(entry, pattern, group)


def _counted(name: str, group: int) -> Column:
    """A count, null for `-`, which is a binary file."""
    x = _part(F.col(name), NUMSTAT, group)
    return F.when(x != "-", x.cast("long"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(hash, timestamp, author, place, entries) of `log -z --numstat -M --format=%x01%H%x00%cI%x00%aN`; commits without files stay.

    The timestamp is the text of the log. Records with fewer than three fields are passed over. `place` sorts the
    commits of a log as they stand in it.
    """
    return parsed(_records(spark, path))


def parsed(records: DataFrame) -> DataFrame:
    """commits() of records (value, place) that are read already, each without its leading mark."""
    head = r"^([^\x00]*)\x00([^\x00]*)\x00([^\x00]*)"
    rows = records.filter(F.col("value").rlike(head))
    rest = F.regexp_replace("value", head, "")
    return rows.select(_part("value", head, 1).alias("hash"), _part("value", head, 2).alias("timestamp"), _part("value", head, 3).alias("author"), "place", _entries(rest, NUMSTAT).alias("entries"))


def changes(log: DataFrame) -> DataFrame:
    """(hash, timestamp, author, path, previous_path, additions, deletions) of the files of commits(); binary counts are null.

    previous_path is null but for renames. Names keep tabs, line ends, spaces and arrows as they are.
    """
    rows = log.select("hash", "timestamp", "author", F.explode("entries").alias("e"))
    inline = _part(F.col("e"), NUMSTAT, 3)
    moved = inline == ""
    return rows.select("hash", "timestamp", "author", F.when(moved, _part(F.col("e"), NUMSTAT, 5)).otherwise(inline).alias("path"), F.when(moved, _part(F.col("e"), NUMSTAT, 4)).alias("previous_path"), _counted("e", 1).alias("additions"), _counted("e", 2).alias("deletions"))


def tracked_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of `ls-files -z` or `ls-tree -z --name-only`."""
    return spark.read.option("lineSep", NUL).text(path).filter("value <> ''").select(F.col("value").alias("path"))


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """(hash, path, status, previous_path) of `log -z --name-status -M --format=%x01%H`; status is the letter."""
    rows = _records(spark, path).select(F.regexp_replace(F.regexp_extract("value", r"^([^\x00]*)", 1), r"\n", "").alias("hash"), F.explode(_entries(F.col("value"), STATUS)).alias("e"))
    two, e = _part("e", STATUS, 1) != "", F.col("e")
    out = rows.filter("hash <> ''").select("hash", F.when(two, _part(e, STATUS, 3)).otherwise(_part(e, STATUS, 5)).alias("path"), F.when(two, _part(e, STATUS, 1)).otherwise(_part(e, STATUS, 4)).alias("status"), F.when(two, _part(e, STATUS, 2)).alias("previous_path"))
    return out


def timeline(spark: SparkSession, numstat: str, status: str, module: str) -> DataFrame:
    """One row a commit of a first-parent history: (hash, timestamp, parents, additions, deletions, changed_files, renamed, added, removed, place).

    numstat is the path of `log -z --numstat -M --first-parent --format=%x01%H%x00%cI%x00%P`, status that of the same with
    --name-status and %x01%H. Counts are over all files, binary ones as 0; renamed (pairs of old and new), added and removed hold
    only paths that match `module`; a rename stands under renamed alone. The oldest commit has the largest place.
    """
    log = commits(spark, numstat).withColumnRenamed("author", "_p")
    parents = F.filter(F.split(F.regexp_replace("_p", r"\n", ""), " "), lambda x: x != "")
    one = F.transform("entries", lambda e: F.struct(_part(e, NUMSTAT, 1).alias("a"), _part(e, NUMSTAT, 2).alias("d"), _part(e, NUMSTAT, 3).alias("inline"), _part(e, NUMSTAT, 4).alias("previous"), _part(e, NUMSTAT, 5).alias("path")))

    def total(side: str) -> Column:
        return F.aggregate("_e", F.lit(0).cast("long"), lambda s, e: s + F.coalesce(F.when(e[side] != "-", e[side].cast("long")), F.lit(0)))

    moved = F.filter("_e", lambda e: (e["inline"] == "") & (e["previous"].rlike(module) | e["path"].rlike(module)))
    rows = log.withColumn("_e", one).select("hash", "timestamp", parents.alias("parents"), total("a").alias("additions"), total("d").alias("deletions"), F.size("_e").alias("changed_files"), F.transform(moved, lambda e: F.struct(e["previous"].alias("previous"), e["path"].alias("path"))).alias("renamed"), "place")
    said = statuses(spark, status).filter(F.col("path").rlike(module) & F.col("status").isin("A", "D"))
    said = said.groupBy("hash").agg(*[F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("path")))).alias(n) for s, n in (("A", "added"), ("D", "removed"))])
    none = F.array().cast("array<string>")
    return rows.join(said, "hash", "left").withColumns({n: F.coalesce(n, none) for n in ("added", "removed")})


def seed_commit(log: DataFrame) -> str | None:
    """The commit whose tree a timeline() starts from: the first parent of its oldest commit, None where that has none."""
    row = log.agg(F.max(F.struct("place", F.get("parents", F.lit(0)).alias("parent"))).alias("m")).first()  # one row
    return row.m.parent if row.m else None


def lifespans(log: DataFrame, seed: DataFrame) -> DataFrame:
    """(path, since, until): hash of the commit that added a module (null for those of the seed tree) and of the one that removed it (null if there).

    log is a timeline(), seed (path) the tree of its seed_commit(). A rename ends the old path and starts the new one. A path may come again:
    each stay is a row. An event that the state before rules out (added while there, removed while absent) is passed over.
    """
    from pyspark.sql import Window

    def event(column: str, kind: int) -> DataFrame:
        return log.select("hash", "place", F.explode(column).alias("path"), F.lit(kind).alias("kind"))

    moved = log.select("hash", "place", F.explode("renamed").alias("r"))
    events = event("added", 1).union(event("removed", 0)).union(moved.select("hash", "place", "r.previous", F.lit(0))).union(moved.select("hash", "place", "r.path", F.lit(1)))
    first = seed.distinct().select(F.lit(None).cast("string").alias("hash"), F.lit(None).cast(log.schema["place"].dataType).alias("place"), "path", F.lit(1).alias("kind"))
    w = Window.partitionBy("path").orderBy(F.desc_nulls_first("place"), "kind")  # the seed, then oldest first
    rows = events.union(first).withColumn("_was", F.coalesce(F.lag("kind").over(w), F.lit(0))).filter("kind <> _was")
    rows = rows.withColumn("_end", F.lead("hash").over(w))
    return rows.filter("kind = 1").select("path", F.col("hash").alias("since"), F.col("_end").alias("until"))
