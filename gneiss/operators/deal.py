"""How many tasks the rows of a large table are dealt over."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of one task, and the rows up to which a table is left to Spark.
TASK_ROWS = 250_000
LEAST_ROWS = 1_000_000


def large(rows: int | None) -> bool:
    return rows is not None and rows > LEAST_ROWS


def tasks(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def deal(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """df dealt by its keys over a task for each TASK_ROWS of `rows`, so that what a task holds does not grow with the table.

    Adaptive execution puts shuffled partitions together by their packed bytes, up to 64 MB for a task, and sorts and hash
    maps hold many times that; it leaves a stated number alone. Joins of two tables dealt alike (both with the larger number),
    and aggregates by these keys, need no other shuffle.
    A table of LEAST_ROWS or less, or of a number not known, stays as it is.
    """
    if not large(rows):
        return df
    return df.repartition(tasks(df, rows), *keys)
