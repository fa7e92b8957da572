"""Token counts of the sections of documents by offset-mapped attribution.

Each document is encoded once, whole, so no token depends on where a section was cut. Every token
has a span of characters; spans are interval-joined to the sections of the text, and a token that
crosses a boundary goes, whole, to one section by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .text import slices

RULES = ("most", "first", "last")

_encodings: dict[str, tuple] = {}


def _encoding(path: str, pattern: str):
    """The byte-level encoding of this worker and the byte length of each of its tokens."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _encodings[path] = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encodings[path]


def line_sections(data: np.ndarray) -> np.ndarray:
    """Byte bounds of the paragraphs of a text: each ends after a newline, the last at the end."""
    ends = np.flatnonzero(data == 0x0A) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends])


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Section of each token span; bounds rise from 0 and cover all spans.

    "first" gives a token to the section of its first byte, "last" to that of its last byte, "most"
    to the section that holds most of its bytes, the earlier of two that hold as many.
    """
    first = np.searchsorted(bounds, starts, "right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    if rule == "last":
        return last
    out = first.copy()
    for i in np.flatnonzero(last > first):
        cut = np.clip(bounds[first[i] : last[i] + 2], starts[i], ends[i])
        out[i] = first[i] + int(np.argmax(np.diff(cut)))
    return out


def section_token_counts(
    docs: DataFrame, encoding_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "most"
) -> DataFrame:
    """Tokens of each section (line, with its newline) of every whole text.

    Returns (id, section, start, length, n_tokens, n_crossing), one row for each section of each
    input row: start and length in characters, n_tokens the tokens that `rule` gives the section,
    n_crossing those of them that lie partly outside it. The n_tokens of a text add up to its
    tokens. Null and empty texts have one empty section without tokens. A newline at the end starts
    no further section. Rows that repeat an id, or have none, are counted each. Other columns are
    ignored. Special-token strings in a text are ordinary text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoding, sizes = _encoding(encoding_path, pattern)
            for part in slices(batch.column(1)):
                raw = part.data.tobytes()
                lead = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])  # characters before each byte
                row, section, start, length, count, crossing = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(part.offsets[:-1], part.offsets[1:])):
                    bounds = line_sections(part.data[a:b])
                    ends = np.cumsum(sizes[np.array(encoding.encode_ordinary(raw[a:b].decode()), np.int64)])
                    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                    own = attribute(starts, ends, bounds, rule)
                    over = (starts < bounds[own]) | (ends > bounds[own + 1])
                    n = len(bounds) - 1
                    at = lead[a + bounds] - lead[a]
                    row.append(np.full(n, i))
                    section.append(np.arange(n))
                    start.append(at[:-1])
                    length.append(np.diff(at))
                    count.append(np.bincount(own, minlength=n))
                    crossing.append(np.bincount(own[over], minlength=n))
                row = np.concatenate(row)
                id_ = batch.column(0).slice(part.rows.start, len(part)).take(pa.array(row))
                rest = [pa.array(np.concatenate(x).astype(np.int64)) for x in (section, start, length, count, crossing)]
                yield pa.RecordBatch.from_arrays([id_, *rest], names=["id", "section", "start", "length", "n_tokens", "n_crossing"])

    return source.mapInArrow(run, "id long, section long, start long, length long, n_tokens long, n_crossing long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = section_token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")
