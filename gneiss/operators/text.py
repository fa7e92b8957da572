"""Line search, chunking and vector top-k."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cosine


def lines_of(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, line, content), lines numbered from 1."""
    return df.select(id_col, F.posexplode(F.split(text, "\n")).alias("_l", "content")).select(id_col, (F.col("_l") + 1).alias("line"), "content")


def read_range(df: DataFrame, id_col: str, text: str, offset: int, limit: int) -> DataFrame:
    """Lines offset .. offset + limit - 1 of each text."""
    return lines_of(df, id_col, text).filter(F.col("line").between(offset, offset + limit - 1))


def grep(df: DataFrame, id_col: str, text: str, pattern: str, mode: str = "content", ignore_case: bool = False) -> DataFrame:
    """Lines that match: "content" gives them, "files" the ids that have one, "count" their number by id."""
    pattern_ = ("(?i)" if ignore_case else "") + pattern
    # Patterns without anchors and look-around match a whole text if they match a line: texts without a match are not split.
    hits = df if re.search(r"\(\?|\\[AZzGbB]|\^|\$", pattern) else df.filter(F.col(text).rlike(pattern_))
    hits = lines_of(hits, id_col, text).filter(F.col("content").rlike(pattern_))
    if mode == "content":
        return hits
    if mode == "files":
        return hits.select(id_col).distinct()
    if mode == "count":
        return hits.groupBy(id_col).agg(F.count("*").alias("matches"))
    raise ValueError(f"unknown mode {mode}")


def fixed_chunks(df: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """Chunks of `size` characters with their character and line spans; an empty text has none."""
    if size <= 0:
        raise ValueError("size must be positive")
    n = F.char_length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    rows = df.select(id_col, F.col(text).alias("_t"), F.posexplode(starts).alias("chunk", "start"))
    part = F.substring("_t", F.col("start") + 1, F.lit(size))
    before = F.regexp_count(F.substring("_t", F.lit(1), F.col("start")), F.lit("\n"))
    rows = rows.select(id_col, "chunk", "start", part.alias("content"), (before + 1).alias("first_line"))
    return rows.select(id_col, "chunk", "start", (F.col("start") + F.char_length("content")).alias("end"), "first_line", (F.col("first_line") + F.regexp_count("content", F.lit("\n"))).alias("last_line"), "content")


def recursive_chunks(df: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """Paragraphs, those of over `size` characters cut. Our own definition of recursive chunking; short ones are not merged."""
    paragraphs = df.select(id_col, F.posexplode(F.split(text, "\n\n+")).alias("_p", "content"))
    cut = fixed_chunks(paragraphs.withColumn("_k", F.struct(id_col, "_p")), "_k", "content", size)
    return cut.select(F.col(f"_k.{id_col}").alias(id_col), F.col("_k._p").alias("paragraph"), "chunk", "content")


def vector_topk(vectors: DataFrame, id_col: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k vectors with the largest cosine to a query, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
