"""Soft-membership mixing: documents are weighted so that expected domain token totals meet targets.

A classifier learns domains from a labelled table and gives every document a posterior over them.
Projected-gradient least squares then fits a nonnegative rate for each document: the squared
relative misses of the domains' expected token totals, and a small pull of all rates towards 1.
The gradient needs the corpus only through one sum for each domain, so each round is one
distributed sum over a narrow written table; a document's rate is the fold of the rounds' steps
over its own posterior and is never shuffled or stored between rounds.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import release_memory, small_batches, trimmed, written
from .subword import SCORED_BYTES, Model, train
from .text import mix, slices, word_ranges
from .toxicity import sample_labelled

#: Most labelled rows of each domain that the classifier learns from.
MAX_LABELLED = 1500
PULL = 1e-3
STEP = 0.9


def train_domains(docs: DataFrame, labels: DataFrame, label_col: str, domains: int, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """Classifier of the domains 0..domains - 1, from at most max_labelled labelled rows of each.

    The share of each domain among all labelled rows is its prior. Without labelled rows every text
    has equal posteriors.
    """
    texts, y = sample_labelled(docs, labels, label_col, dict.fromkeys(range(domains), max_labelled), id_col, text_col)
    model = train(texts, y, domains, pool="mean", epochs=int(np.clip(9_000 // max(1, len(texts)), 3, 20)))
    del texts
    release_memory()  # the sample and the training's arrays
    counts = {r[0]: r[1] for r in labels.groupBy(F.col(label_col).cast("int")).count().collect() if r[0] is not None}
    prior = np.array([counts.get(c, 0) for c in range(domains)], float) + 0.5
    model.bias = model.bias + np.log(prior / prior.sum())
    return model


def _memberships(model: Model, part) -> tuple[np.ndarray, np.ndarray]:
    """(words, posteriors) of each text of a slice."""
    return np.diff(word_ranges(part)[2]), model.probabilities(part)


def domain_memberships(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, posterior): words of the whole text and its domain posteriors; null texts have none."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), SCORED_BYTES):
                tokens, p = _memberships(shared.value, part)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.rows.start, len(part)), pa.array(tokens), lists], names=["id", "tokens", "posterior"])

    return source.mapInArrow(trimmed(run), "id long, tokens long, posterior array<double>")


def rates_of(posterior: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the given gradient steps, each projected to 0 or more."""
    r = np.ones(len(posterior))
    for s in steps:
        r = np.maximum(0.0, r - posterior @ s - STEP * PULL * (r - 1))
    return r


def fit_rates(members: DataFrame, targets: list[float], rounds: int = 60, tolerance: float = 1e-4) -> list[np.ndarray]:
    """Gradient steps that bring the domains' expected token totals to their targets.

    members is (tokens, posterior); targets are shares of the corpus' own token total. A target that
    no nonnegative rates reach (a domain without any posterior mass) is approached as far as they can;
    what is still missed after the last round is given as a warning.
    """
    target = np.asarray(targets, float)
    if (target < 0).any() or target.sum() <= 0:
        raise ValueError("targets must be nonnegative and not all zero")
    target = target / target.sum()
    size = len(target)
    narrow = members.select("tokens", "posterior")

    def totals(steps: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                t = batch.column(0).to_numpy(zero_copy_only=False)
                total += (t * rates_of(p, steps)) @ p
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["domain", "total"])

        sums = narrow.mapInArrow(run, "domain int, total double").groupBy("domain").agg(F.sum("total")).collect()
        out = np.zeros(size)
        for domain, total in sums:
            out[domain] = total
        return out

    steps: list[np.ndarray] = []
    natural = totals(steps)
    mass = natural.sum()
    if mass == 0:
        return steps
    share = np.maximum(natural / mass, 1e-6)
    now = natural / mass
    for _ in range(rounds):
        miss = now - target
        if np.abs(miss).max() < tolerance:
            break
        steps.append(STEP * miss / share)
        now = totals(steps) / mass
    else:
        warnings.warn(f"domain shares of {now.round(4).tolist()} after {rounds} rounds, targets {target.round(4).tolist()}", stacklevel=2)
    return steps


def _uniform(ids: pa.Array) -> np.ndarray:
    """A fixed number in [0, 1) for each id."""
    values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return (mix(values + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def mixed(docs: DataFrame, model: Model, steps: list[np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row floor(rate + u) times, u a fixed hash of the id: the expected copies are the rate."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at, who = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(at), SCORED_BYTES):
                own = batch.slice(part.rows.start, len(part))
                r = rates_of(_memberships(shared.value, part)[1], steps)
                copies = np.floor(r + _uniform(own.column(who))).astype(np.int64)
                yield own.take(pa.array(np.repeat(np.arange(len(part)), copies)))

    return docs.mapInArrow(trimmed(run), docs.schema)


def mix_to_targets(docs: DataFrame, labels: DataFrame, label_col: str, targets: list[float], id_col: str = "doc_id", text_col: str = "text"):
    """Fit a mixture: returns (members, model, steps), members with each document's rate and copies.

    members has one row for each input row: id, tokens, posterior, rate, copies. Documents without
    words have the prior as posterior and no tokens, and the rate it leads to. Null ids are allowed.
    """
    model = train_domains(docs, labels, label_col, len(targets), id_col, text_col)
    members = written(domain_memberships(docs, model, id_col, text_col))
    steps = fit_rates(members, targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(targets))
            r = rates_of(p, steps)
            copies = np.floor(r + _uniform(batch.column(0))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r), pa.array(copies)], names=[*batch.schema.names, "rate", "copies"])

    schema = T.StructType([*members.schema.fields, T.StructField("rate", T.DoubleType()), T.StructField("copies", T.LongType())])
    return members.mapInArrow(run, schema), model, steps


#: Token shares of documents labelled as of low and of high quality.
QUALITY_TARGETS = [0.05, 0.95]


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    members, _, _ = mix_to_targets(docs, labels, "quality", QUALITY_TARGETS)
    return members.select(F.col("id").alias("doc_id"), "tokens", F.col("posterior")[0].alias("p_low"), F.col("posterior")[1].alias("p_high"), "rate", "copies")
