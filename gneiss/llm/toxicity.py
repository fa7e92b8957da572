"""Toxicity scores from subword-bag embeddings averaged into a linear softmax (see subword.py).

Windows of three words are averaged and the most toxic ones decide, so a long text is judged like
a short one. The model is fitted on the driver on a bounded sample of labelled rows; scoring runs
over every whole text with a broadcast table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import release_memory, small_batches, trimmed
from .subword import SCORED_BYTES, Model, train
from .text import slices

#: Most labelled rows that the classifier learns from.
MAX_TOXIC, MAX_CLEAN = 1500, 3000
THRESHOLD = 0.3


def learns_from(id_col: str = "doc_id"):
    """True for ids whose labels may be learnt, a null id among them; the others are held out."""
    return F.expr(f"coalesce(crc32(cast(`{id_col}` as string)) % 4 <> 2, true)")


def sample_labelled(docs: DataFrame, labels: DataFrame, label_col: str, limits: dict[int, int], id_col: str = "doc_id", text_col: str = "text"):
    """(texts, labels) of at most limits[c] labelled rows of each class c, lowest hash of the id first."""
    labelled = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    picks = None
    for c, most in limits.items():
        one = labelled.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(most)
        picks = one if picks is None else picks.union(one)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picks), "id").collect()  # at most sum(limits) labels, so the broadcast is bounded
    rows.sort(key=lambda r: (r.id, r.label, r.text))
    return [r.text for r in rows], np.array([r.label for r in rows], np.int64)


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on at most max_toxic rows labelled 1 and max_clean labelled 0; rows with other labels or no text row are not used.

    Only labels given here are learnt: leave out those to be held out. Without any labelled row the
    model scores every text 0.5.
    """
    texts, y = sample_labelled(docs, labels, label_col, {1: max_toxic, 0: max_clean}, id_col, text_col)
    epochs = int(np.clip(18_000 // max(1, len(texts)), 4, 20))  # small samples are read more often
    model = train(texts, y, 2, pool="max", epochs=epochs)
    del texts
    release_memory()  # the sample and the training's arrays
    return model


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of docs and score_col, the probability (0 to 1) that the text is toxic.

    Every row is scored by its text alone, in place, without a shuffle. Null and blank texts get the
    model's score of a text without words. A column already named score_col is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.probabilities(part)[:, 1] for part in slices(batch.column(at), SCORED_BYTES)]
            score = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(trimmed(run), schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(learns_from())
    scored = with_toxicity(docs, train_toxicity(docs, labels))
    return scored.select("doc_id", (~learns_from()).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
