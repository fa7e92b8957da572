"""From raw documents to packed training sequences.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame. Every stage works on all that the
one before it kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import lines, minhash, mixing, packing, toxicity
from gneiss.llm.store import release, release_memory, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity classifier scores at its threshold or higher."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train_toxicity(docs, _labels(spark, sf_dir).filter(toxicity.learns_from()))
    return toxicity.with_toxicity(docs, model, score_col="toxicity").filter(F.col("toxicity") < toxicity.THRESHOLD).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that an earlier line equals or nearly equals; documents left without a word by that go."""
    rest = ("lang", "source")
    out = lines.line_dedup(docs, carry=rest)
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(F.col("id").alias("doc_id"), "text", F.col("carry_0").alias("lang"), F.col("carry_1").alias("source"), F.char_length("text").cast("long").alias("n_chars"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    kept = minhash.near_duplicates(docs, shingle_words=5, percent=80).filter("kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").select(*COLUMNS)


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thin or repeat documents so that quality domains meet their target shares of words."""
    docs = docs.select(*COLUMNS)
    _, model, steps = mixing.mix_to_targets(docs, _labels(spark, sf_dir), "quality", mixing.QUALITY_TARGETS)
    return mixing.mixed(docs, model, steps)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", without_near_duplicates),
    ("mixing", mixed_to_targets),
    ("best_fit_packing", packed),
]

#: SQL cannot express the trained classifiers and the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir, each result written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            out = written(out)
            release(docs)  # what the stage before wrote
            release_memory()
        docs = out
    return docs
