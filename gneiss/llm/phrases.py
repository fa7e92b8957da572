"""Phrase collocations: runs of words that occur together more often than their parts would by chance.

Words, pairs and longer runs are exploded into DataFrame rows (those of one batch already counted)
and hash-aggregated per language. A run cannot be frequent unless each run inside it is, so pairs
are exploded only where both words are frequent, and longer runs only where all their pairs are.
Tasks learn that from a bit filter of bounded size, which never misses a frequent run; what it
lets through wrongly is counted and goes by its count. All counts are thus exact.

Counts of the two parts of each cut are joined to the frequent runs, scores are Decimal quotients,
and runs that a one-word extension covers are anti-joined away: if a longer run holds this one and
is as frequent, so is the one-word extension of this one inside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import join_groups, join_salted
from .store import release, small_batches, trimmed, written
from .text import lowered, mix, range_hashes, slices

#: Most bits of the filter that tasks hold; beyond it the filter lets more through, which costs time only.
FILTER_BITS = 1 << 27
CHUNK_BYTES = 4 << 20  # text whose runs are counted together before they become rows

_WORD_END = np.zeros(256, bool)
_WORD_END[[0x20, 0x09]] = True
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAK = _WORD_END | _PIECE_END


def _codes(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct strings of a column and the place of each row's."""
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _salted(hashes: np.ndarray, lang: bytes) -> np.ndarray:
    """Hashes of texts made hashes of (language, text)."""
    own = range_hashes(np.frombuffer(lang, np.uint8), np.array([0]), np.array([len(lang)]))[0]
    return mix(hashes ^ own)


class RunFilter:
    """A bit for each hash: set for every frequent run, so an unset bit proves that a run is not."""

    def __init__(self, words: np.ndarray):
        self.words = words  # uint64, a power of two of them

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes & np.uint64(len(self.words) * 64 - 1)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


class _Chunk:
    """The words of a slice end to end, one space between, with the piece that each lies in."""

    def __init__(self, part):
        data = lowered(part.data)
        word = ~_BREAK[data]
        first = np.zeros(len(data) + 1, bool)
        first[part.offsets] = True
        starts = word.copy()
        starts[1:] &= ~word[:-1] | first[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first[1:-1]
        at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(part.offsets, at, "right") - 1
        self.piece = np.cumsum(_PIECE_END[data])[at] + self.row if len(at) else at
        size = to - at
        self.start = np.cumsum(size + 1) - size - 1
        self.end = self.start + size
        self.text = np.full(int(size.sum() + len(size)), 0x20, np.uint8)
        self.text[self._bytes(self.start, size)] = data[self._bytes(at, size)]

    @staticmethod
    def _bytes(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(size):
            return np.zeros(0, np.int64)
        return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)

    def runs(self, n: int) -> np.ndarray:
        """First words of all runs of n words inside one piece."""
        m = len(self.start) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[:m] == self.piece[n - 1 :])

    def hashes(self, first: np.ndarray, n: int) -> np.ndarray:
        return range_hashes(self.text, self.start[first], self.end[first + n - 1]) if len(first) else np.zeros(0, np.uint64)

    def strings(self, first: np.ndarray, n: int) -> pa.Array:
        size = self.end[first + n - 1] - self.start[first]
        offsets = np.zeros(len(first) + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(self.text[self._bytes(self.start[first], size)]))


def _exploder(sizes: tuple[int, ...], span: int, shared):
    """Rows (lang, words, phrase, f) of the runs of `sizes` words; with a filter, of those whose runs of `span` words it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), CHUNK_BYTES):
                chunk = _Chunk(part)
                names, code = _codes(batch.column(0).slice(part.rows.start, len(part)))
                lang = code[chunk.row]
                good = None
                if shared is not None and len(chunk.start):
                    first = chunk.runs(span)
                    h = chunk.hashes(first, span)
                    held = np.zeros(len(first), bool)
                    for c, name in enumerate(names):
                        mine = lang[first] == c
                        held[mine] = shared.value.holds(_salted(h[mine], name.encode()))
                    good = np.zeros(len(chunk.start), bool)
                    good[first[held]] = True
                for n in sizes:
                    first = chunk.runs(n)
                    if good is not None:
                        for k in range(n - span + 1):
                            first = first[good[first + k]]
                    for c in np.unique(lang[first]):
                        found = pc.value_counts(chunk.strings(first[lang[first] == c], n))
                        if len(found):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([names[c]] * len(found), pa.string()), pa.array(np.full(len(found), n, np.int32)), found.field(0), found.field(1)],
                                names=["lang", "words", "phrase", "f"],
                            )

    return run


def _counted(texts: DataFrame, sizes: tuple[int, ...], span: int = 1, shared=None) -> DataFrame:
    rows = texts.mapInArrow(trimmed(_exploder(sizes, span, shared)), "lang string, words int, phrase string, f long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def _bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = []
        for part in slices(batch.column(1)):
            h.append(range_hashes(part.data, part.offsets[:-1], part.offsets[1:]))
        h = np.concatenate(h) if h else np.zeros(0, np.uint64)
        names, code = _codes(batch.column(0))
        for c, name in enumerate(names):
            bit = _salted(h[code == c], name.encode()) & np.uint64(bits - 1)
            at = pa.array((bit >> np.uint64(6)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([at, pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], names=["at", "word"])


def _filter(frequent: DataFrame, count: int) -> RunFilter:
    """The filter of all runs of `frequent`: 16 bits a run, FILTER_BITS at most."""
    bits = 1 << 12
    while bits < min(16 * count, FILTER_BITS):
        bits *= 2
    rows = frequent.select("lang", "phrase").mapInArrow(lambda b: _bits(b, bits), "at int, word long")
    found = rows.groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()  # bits / 64 rows at most
    words = np.zeros(bits // 64, np.uint64)
    words[found["at"].to_numpy()] = found["word"].to_numpy(np.int64).view(np.uint64)
    return RunFilter(words)


def frequent_runs(texts: DataFrame, max_words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all runs of up to max_words words with f >= least, and (lang, n) of all words.

    texts has (lang, text), lang not null.
    """
    spark = texts.sparkSession
    small_batches(spark)
    words = written(_counted(texts, (1,)))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [words.filter(F.col("f") >= least)]
    for sizes, span in (((2,), 1), (tuple(range(3, max_words + 1)), 2)):
        sizes = tuple(n for n in sizes if n <= max_words)
        if sizes:
            shared = spark.sparkContext.broadcast(_filter(levels[-1], levels[-1].count()))  # FILTER_BITS / 8 bytes at most
            levels.append(written(_counted(texts, sizes, span, shared).filter(F.col("f") >= least)))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    frequent, totals = written(out), written(totals)
    for table in (words, *levels[1:]):
        release(table)
    return frequent, totals


def collocations(docs: DataFrame, max_words: int = 5, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The `top` best phrases of each language, (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
    ``[^\\x20\\x09]+``. A candidate has 2 to max_words words and a >= least occurrences within pieces. Of
    its cuts into l and r occurrences of the parts, the one with the lowest floor(1000 a n / (l r))
    counts, the earliest of equals; n is the number of words of the language. Candidates inside a longer one that is as
    frequent are dropped. Ranks go by score descending, a descending, phrase in byte order.

    Null texts are empty, a null language is `und`. Repeated rows count each time. Languages without candidates have no rows; an
    empty table gives none. Products are Decimal(38): exact while 1000 a n and l r have 38 digits at most, as
    counts to 10^17 do. Other columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    frequent, totals = frequent_runs(texts, max_words, least)
    candidates = frequent.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    # One-word extensions: the largest count of any, taken before the shuffle, then an anti-join.
    longer = candidates.filter("words > 2").select("lang", F.explode(F.array(F.expr("substring(phrase, locate(' ', phrase) + 1)"), F.expr("substring_index(phrase, ' ', words - 1)"))).alias("phrase"), "a")
    covering = longer.groupBy("lang", "phrase").agg(F.max("a").alias("covered"))
    left = candidates.alias("c").join(covering.alias("x"), F.expr("c.lang = x.lang and c.phrase = x.phrase and x.covered >= c.a"), "left_anti")
    cuts = left.select(
        "lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - words)").alias("tail"))
    cuts = written(cuts)
    counts = frequent.select("lang", "phrase", "f")
    scored = cuts
    for part, name in (("head", "l"), ("tail", "r")):  # a common word is part of many candidates: its rows are dealt apart
        sizes = cuts.groupBy("lang", part).agg(F.count("*").alias("rows"))
        sized = counts.withColumnsRenamed({"phrase": part, "f": name}).join(sizes, ["lang", part])
        scored = join_salted(scored, sized, ["lang", part], "rows", 1000).drop("rows")
    sizes = cuts.groupBy("lang").agg(F.count("*").alias("rows"))
    scored = join_groups(scored, totals.join(sizes, "lang"), ["lang"], "rows", cuts.count())
    score = F.expr("cast(1000 * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0)) as decimal(38, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))
    best = written(best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")))
    release(cuts)
    # Ranked in two steps, so that no task holds all candidates of a language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = max(1, int((best.count() / top) ** 0.5))
    near = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
with p as (
  select doc_id, coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
g as (
  select lang, k as words, array_to_string(ws[i:i + k - 1], ' ') as phrase
  from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (select unnest([1, 2, 3, 4, 5]) as k))),
f as (select lang, words, phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::hugeint as n from f where words = 1 group by lang),
c as (select lang, words, phrase, string_split(phrase, ' ') as ws, f as a from f where words > 1 and f >= 100),
x as (
  select lang, unnest([array_to_string(ws[2:], ' '), array_to_string(ws[:len(ws) - 1], ' ')]) as phrase, a from c where words > 2),
d as (select c.* from c where not exists (select 1 from x where x.lang = c.lang and x.phrase = c.phrase and x.a >= c.a)),
k as (select *, unnest(range(1, words)) as k from d),
s as (
  select k.lang, k.phrase, k.a, k.k, l.f as l, r.f as r, n.n, (1000::hugeint * k.a * n.n) // (l.f::hugeint * r.f) as score
  from k join n on n.lang = k.lang
  join f l on l.lang = k.lang and l.phrase = array_to_string(k.ws[:k.k], ' ')
  join f r on r.lang = k.lang and r.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank,
  phrase, a, l, r, n::bigint as n, score::bigint as score
from b qualify rank <= 2000
"""
