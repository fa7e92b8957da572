"""The tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.deal import deal


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with the customer and date of their order, dealt by the order."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = table(spark, folder, "lineitem")
    n = count(spark, folder, "lineitem")
    return deal(rows, n, "l_orderkey").join(deal(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def count(spark: SparkSession, folder: str, name: str) -> int:
    """Rows of a table, from the footers of its files."""
    return table(spark, folder, name).count()
