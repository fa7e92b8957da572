"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where a local session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gneiss-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/") + "/gneiss"


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: a durable cut of the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gneiss_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a written() table that no later plan reads."""
    path = getattr(df, "_gneiss_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers Arrow batches of few rows: a row here holds a whole text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def release_memory() -> None:
    """Give memory that a finished task of this worker no longer uses back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it likes
        pass


def trimmed(run):
    """The batch function `run`, after which its task's memory goes back to the system."""

    def whole(batches):
        yield from run(batches)
        release_memory()

    return whole


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
