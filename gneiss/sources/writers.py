"""Sinks: sharded datasets, staged publishing, keyed merges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.sets import merged


def write_shards(df: DataFrame, path: str, package: str = "package", id_col: str = "id") -> None:
    """One folder for each package, rows sorted by id inside its files; large packages are split by Spark's rebalance."""
    df.hint("rebalance", package).sortWithinPartitions(package, id_col).write.mode("overwrite").partitionBy(package).parquet(path)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _move(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")


def publish(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap it in by renames, each of which is checked.

    If the new table cannot be put in place the old one is put back, and an error is raised; neither
    is deleted before the new one stands. Staging that never became the table is removed. Between the
    two renames a reader may find no table: readers that cannot retry should read versions (publish_version).
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    fs, target = _fs(spark, path)
    _, stage = _fs(spark, staging)
    _, old = _fs(spark, f"{staging}.old")
    try:
        df.write.parquet(staging)
        replaced = fs.exists(target)
        if replaced:
            _move(fs, target, old)
        try:
            _move(fs, stage, target)
        except Exception:
            if replaced:
                _move(fs, old, target)
            raise
        if replaced:
            fs.delete(old, True)
    finally:
        fs.delete(stage, True)


def publish_version(df: DataFrame, path: str) -> str:
    """Write a new version folder under path and name it in a file of path/_versions: readers see the newest whole version."""
    spark = df.sparkSession
    fs, root = _fs(spark, f"{path.rstrip('/')}/_versions")
    fs.mkdirs(root)
    number = 1 + max((int(f.getPath().getName()) for f in fs.listStatus(root)), default=0)
    folder = f"{path.rstrip('/')}/v{number:08d}"
    df.write.parquet(folder)
    _, mark = _fs(spark, f"{path.rstrip('/')}/_versions/{number}")
    fs.create(mark, False).close()  # fails if another writer has taken the number
    return folder


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that publish_version() has finished."""
    fs, root = _fs(spark, f"{path.rstrip('/')}/_versions")
    number = max(int(f.getPath().getName()) for f in fs.listStatus(root))
    return spark.read.parquet(f"{path.rstrip('/')}/v{number:08d}")


def upsert(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], deleted: str) -> None:
    """Apply keyed changes to a Parquet table: deletes, replacements and inserts in one publish."""
    publish(merged(spark.read.parquet(path), changes, keys, deleted), path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
