"""Language-model scores from an Elias-Fano trigram trie, built and queried in shards.

The model joins the counts of three orders before it divides:
P(w | u v) = (c(u v w) + PAIR c(v w) + BASE P(w)) / (c(u v) + PAIR c(v) + BASE),
which sums to 1 for every context. Unigrams are smoothed by one half, with one place for all
unknown words; all words have n-grams of their own.

A shard holds all tokens of its last words w, so every count in the numerator is its own, and so is
the denominator of the token that follows w: c(v w) + PAIR c(w) + BASE. Logarithms of both add up,
and a text gets one partial sum from each shard; nothing is looked up anywhere else, and no count
but those below is sent. A word, pair or triple that alone would fill a shard (at most `width` of
each, counted first) is broadcast with its count and its tokens are dealt by the word before it, by
the one before that, or by their text.

Each task packs the trigrams of its texts, with the text they come from, into one block for each
shard. A shard counts those of training texts, builds its part of the trie in memory-mapped levels,
last word first, and answers every packed trigram by successor search relative to its parent.
Blocks name the FREQUENT most frequent words by their place in a broadcast table, which only saves
bytes; other words are named by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import release, release_memory, shuffle_width, small_batches, written
from .text import mix, slices, words
from .trie import NgramTrie

PAIR, BASE = 0.01, 10.0
FREQUENT = 1 << 18
CHUNK_BYTES = 4 << 20
HELD = 1 << 19  # distinct keys a task holds before it passes them on
LEAST_HOT = 1000  # tokens below which nothing is dealt apart

_END = np.uint64(0x5EED0E4D5EED0E4D)  # the end token's hash
_START = np.uint64(0x5EED57A25EED57A2)  # the start's


def _merged(held: list[tuple]) -> tuple[np.ndarray, ...]:
    keys, *counts = (np.concatenate(x) for x in zip(*held))
    k, inverse = np.unique(keys, return_inverse=True)
    return k, *(np.bincount(inverse, c, len(k)).astype(np.int64) for c in counts)


def _counts(docs: DataFrame, keys_of) -> DataFrame:
    """(word, n, met) of the keys that keys_of(words, texts) gives with the row of each: n in texts to learn from, met in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            k, n, met = _merged(held)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n), pa.array(met)], names=["word", "n", "met"])

        for batch in batches:
            learnt = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for part in slices(batch.column(1)):
                keys, row = keys_of(words(part, lower=True), len(part))
                k, inverse = np.unique(keys, return_inverse=True)
                held.append((k, np.bincount(inverse, learnt[part.rows][row], len(k)), np.bincount(inverse, minlength=len(k))))
                size += len(k)
                if size > HELD:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > HELD:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()
        held = None
        release_memory()

    return docs.mapInArrow(run, "word long, n long, met long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, met): counts of all lower-cased words of (id, text, train), and of one end for each text."""

    def keys_of(w, texts: int):
        return np.concatenate([w.hashes, np.full(texts, _END)]), np.concatenate([w.row_of_word(), np.arange(texts)])

    return _counts(docs, keys_of)


def _trigrams(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(u, v, w, row) of all tokens of texts of the given numbers of words; start, start precede each and an end closes it."""
    rows = len(sizes)
    row = np.repeat(np.arange(rows), sizes + 1)
    edge = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
    w = np.full(edge[-1], _END)
    w[np.arange(len(hashes)) + np.repeat(np.arange(rows), sizes)] = hashes
    v = np.full(len(w), _START)
    v[1:] = w[:-1]
    v[edge[:-1]] = _START
    u = np.full(len(w), _START)
    u[1:] = v[:-1]
    u[edge[:-1]] = _START
    return u, v, w, row


def _gram(*names: np.ndarray) -> np.ndarray:
    """One key for each sequence of names, told apart by their number."""
    key = np.full(len(names[0]), np.uint64(len(names)))
    for x in names:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x)
    return key


@dataclass
class Shared:
    """What every task knows: totals, the frequent words, and the counts of what alone would fill a shard."""

    tokens: int
    distinct: int
    texts: int
    frequent: np.ndarray  # rising hashes; the marks are among them
    pair: float
    base: float
    hot: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # keys rising and counts of words, pairs, triples

    @property
    def total(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def hot_at(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Place of each key among the hot ones of an order, -1 elsewhere."""
        known = self.hot[order][0]
        if not len(known):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, at, -1)


def _hot_grams(source: DataFrame, hot_words: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of pairs and triples that end in a hot word and are met at least `least` times."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not len(hot_words):
        return [none, none]

    def keys_of(w, texts: int):
        u, v, last, row = _trigrams(w.hashes, w.counts())
        pick = np.isin(last, hot_words)
        u, v, last, row = u[pick], v[pick], last[pick], row[pick]
        return np.concatenate([_gram(v, last) & ~np.uint64(1), _gram(u, v, last) | np.uint64(1)]), np.concatenate([row, row])

    found = _counts(source, keys_of).filter(F.col("met") >= least).toPandas().sort_values("word")  # a bounded number, as each is a share of all tokens
    keys = found["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, counts = keys[order], found["n"].to_numpy(np.int64)[order]
    odd = (keys & np.uint64(1)).astype(bool)
    return [(keys[~odd], counts[~odd]), (keys[odd], counts[odd])]


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _read_planes(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel()


def _pack(codes: list[np.ndarray], doc: np.ndarray, n: np.ndarray, names: np.ndarray, ids: np.ndarray, train: np.ndarray, frequent: int) -> bytes:
    """Codes of u, v, w with text and count as one compressed block; a code of `frequent` or more is a place in the block's names."""
    flat = np.concatenate(codes)
    rare = flat >= frequent
    some, place = np.unique(flat[rare], return_inverse=True)
    flat = flat.copy()
    flat[rare] = frequent + place
    used, doc = np.unique(doc, return_inverse=True)
    planes = b"".join(_planes(c.astype("<u4")) for c in (*np.split(flat, 3), doc, n))
    planes += _planes(np.diff(names[some - frequent], prepend=np.uint64(0)).astype("<u8"))
    texts = np.diff(ids[used], prepend=0).astype("<i8").tobytes() + train[used].astype(np.uint8).tobytes()
    head = np.array([len(doc), len(some), len(used)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + planes + texts)


def _unpack(block: bytes) -> tuple[np.ndarray, ...]:
    """(names, u, v, w, place of the text, count, ids of the texts, whether each is learnt from)."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, some, texts = np.frombuffer(raw, "<u4", 3).tolist()
    u, v, w, doc, count = (_read_planes(raw, "<u4", n, 12 + 4 * n * i) for i in range(5))
    at = 12 + 20 * n
    names = np.cumsum(_read_planes(raw, "<u8", some, at), dtype=np.uint64)
    at += 8 * some
    who = np.cumsum(np.frombuffer(raw, "<i8", texts, at))
    train = np.frombuffer(raw, np.uint8, texts, at + 8 * texts).astype(bool)
    return names, u, v, w, doc, count, who, train


def _dealt(shared, parts: int):
    """Blocks of trigrams for the shards, which hold every token once."""

    def chunk(tokens: list[tuple]) -> Iterator[pa.RecordBatch]:
        s: Shared = shared.value
        ids, train, hashes, sizes = (np.concatenate([t[i] for t in tokens]) for i in range(4))
        order = np.argsort(ids, kind="stable")
        u, v, w, row = _trigrams(hashes, sizes)
        to = w.copy()  # what a token is dealt by
        hot = np.flatnonzero(s.hot_at(0, w) >= 0)
        if len(hot):
            pair = _gram(v[hot], w[hot]) & ~np.uint64(1)
            to[hot] = pair
            hot = hot[s.hot_at(1, pair) >= 0]
            triple = _gram(u[hot], v[hot], w[hot]) | np.uint64(1)
            to[hot] = triple
            hot = hot[s.hot_at(2, triple) >= 0]
            to[hot] = _gram(to[hot], ids[row[hot]].view(np.uint64))
        shard = (mix(to) % np.uint64(parts)).astype(np.int32)
        # Codes: the place among the frequent words, or after them among the chunk's other words.
        names, inverse = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(s.frequent, names), len(s.frequent) - 1)
        known = s.frequent[at] == names
        code = np.where(known, at, len(s.frequent) + np.cumsum(~known) - 1)
        names = names[~known]
        end, start = np.searchsorted(s.frequent, [_END, _START])
        line = np.full(len(w), end, np.int64)
        line[np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)] = code[inverse]
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        before = np.full(len(w), start, np.int64)
        before[1:] = line[:-1]
        before[first] = start
        earlier = np.full(len(w), start, np.int64)
        earlier[1:] = before[:-1]
        earlier[first] = start
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        doc = rank[row]
        ids, train = ids[order], train[order]
        order = np.lexsort((doc, earlier, before, line, shard))
        shard, u, v, w, doc = (x[order] for x in (shard, earlier, before, line, doc))
        new = np.ones(len(w), bool)
        new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (doc[1:] != doc[:-1]) | (shard[1:] != shard[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(w)))
        shard, u, v, w, doc = (x[at] for x in (shard, u, v, w, doc))
        present, cut = np.unique(shard, return_index=True)
        cut = np.append(cut, len(shard))
        blocks = [_pack([u[a:b], v[a:b], w[a:b]], doc[a:b], n[a:b], names, ids, train, len(s.frequent)) for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(present), pa.array(blocks, pa.binary())], names=["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for part in slices(batch.column(1)):
                w = words(part, lower=True)
                tokens.append((ids[part.rows], train[part.rows], w.hashes, w.counts()))
                held += len(part.data) + 64 * len(part)
                if held > CHUNK_BYTES:
                    yield from chunk(tokens)
                    tokens, held = [], 0
        if tokens:
            yield from chunk(tokens)
        tokens = None
        release_memory()

    return run


#: Partial sums: text, tokens, known tokens, and the two scores as whole multiples of these steps.
_STEPS = (None, None, 2.0**-30, 2.0**-16)


def _sums(ids: np.ndarray, columns: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Partial sums of texts, added up by id and packed in one block for each part of the ids."""
    ids, row = np.unique(ids, return_inverse=True)
    whole = [np.rint(np.bincount(row, c, len(ids)) / (step or 1)).astype("<i8") for c, step in zip(columns, _STEPS)]
    part = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    present, cut = np.unique(part[order], return_index=True)
    blocks = []
    for rows in np.split(order, cut[1:]):
        raw = _planes(np.diff(ids[rows], prepend=0).astype("<i8")) + b"".join(_planes(c[rows]) for c in whole)
        blocks.append(zstandard.ZstdCompressor(level=1).compress(raw))
    yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), pa.array(blocks, pa.binary())], names=["part", "block"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each id from the packed partial sums of all shards."""
    held = []
    for batch in batches:
        for block in batch.column(1).to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(block)
            n = len(raw) // 40
            ids, *sums = (_read_planes(raw, "<i8", n, 8 * n * i) for i in range(5))
            held.append((np.cumsum(ids), *sums))
    if held:
        ids, row = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        out = []
        for c, step in enumerate(_STEPS):
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, row, np.concatenate([h[c + 1] for h in held]))
            out.append(pa.array(total if step is None else total * step))
        yield pa.RecordBatch.from_arrays([pa.array(ids), *out], names=["id", "n", "known", "base", "score"])


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _answered(shared, parts: int):
    """Packed partial sums of each text from the rows of a shard."""

    def scored(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        s: Shared = shared.value
        frequent = len(s.frequent)
        opened = [_unpack(x) for x in blocks]
        blocks.clear()
        names, place = np.unique(np.concatenate([x[0] for x in opened]), return_inverse=True)
        at = np.cumsum([0] + [len(x[0]) for x in opened]).tolist()
        texts_at = np.cumsum([0] + [len(x[6]) for x in opened]).tolist()

        def ids_of(code: np.ndarray, first: int) -> np.ndarray:
            out = code.astype(np.int32)
            rare = code >= frequent
            out[rare] = frequent + place[code[rare].astype(np.int64) - frequent + first]
            return out

        u, v, w = (np.concatenate([ids_of(x[c], o) for x, o in zip(opened, at)]) for c in (1, 2, 3))
        doc = np.concatenate([(x[4] + o).astype(np.int32) for x, o in zip(opened, texts_at)])
        n = np.concatenate([x[5] for x in opened])
        who = np.concatenate([x[6] for x in opened])
        train = np.concatenate([x[7] for x in opened])
        del opened, place
        order = np.lexsort((u, v, w)).astype(np.int32)
        u, v, w, doc, n = (x[order] for x in (u, v, w, doc, n))
        del order
        # Distinct triples, pairs and words, each with the counts of training texts.
        t = _starts(u, v, w)
        length = np.diff(np.append(t, len(w)))
        c3 = np.add.reduceat(np.where(train[doc], n, 0), t).astype(np.int64)
        u, v, w = u[t], v[t], w[t]
        p = _starts(v, w)
        pair = np.repeat(np.arange(len(p)), np.diff(np.append(p, len(w))))
        c2 = np.add.reduceat(c3, p)
        o = _starts(w[p])
        word = np.repeat(np.arange(len(o)), np.diff(np.append(o, len(p))))
        c1 = np.add.reduceat(c2, o)
        if len(s.hot[0][0]):
            hashes = np.concatenate([s.frequent, names])
            hot = s.hot_at(0, hashes[w[p][o]])
            c1 = np.where(hot >= 0, s.hot[0][1][hot], c1)
            some = np.flatnonzero(hot[word] >= 0)
            hot = s.hot_at(1, _gram(hashes[v[p][some]], hashes[w[p][some]]) & ~np.uint64(1))
            if len(s.hot[1][0]):
                c2[some] = np.where(hot >= 0, s.hot[1][1][hot], c2[some])
            if len(s.hot[2][0]):
                some = np.flatnonzero(np.isin(pair, some[hot >= 0]))
                hot = s.hot_at(2, _gram(hashes[u[some]], hashes[v[some]], hashes[w[some]]) | np.uint64(1))
                c3[some] = np.where(hot >= 0, s.hot[2][1][hot], c3[some])
            del hashes
        word_of = word[pair]
        base = np.log10((c1 + 0.5) / s.total)
        share = s.base * (c1 + 0.5) / s.total
        known = c1 > 0
        sums = [np.bincount(doc, n, len(who)), np.bincount(doc, n * np.repeat(known[word_of], length), len(who)), np.bincount(doc, n * np.repeat(base[word_of], length), len(who))]
        # The trie of what training texts hold, last word first.
        k1, k2, k3 = np.flatnonzero(c1 > 0), np.flatnonzero(c2 > 0), np.flatnonzero(c3 > 0)
        up = np.full(len(c1), -1)
        up[k1] = np.arange(len(k1))
        upper = np.full(len(c2), -1)
        upper[k2] = np.arange(len(k2))
        trie = NgramTrie(
            [
                (np.zeros(len(k1), np.int64), w[p][o][k1], np.log10(share[k1]), np.log10(s.pair * c1[k1] + s.base)),
                (up[word[k2]], v[p][k2], np.log10(s.pair * c2[k2] + share[word[k2]]), np.log10(c2[k2] + s.pair * c1[word[k2]] + s.base)),
                (upper[pair[k3]], u[k3], np.log10(c3[k3] + s.pair * c2[pair[k3]] + share[word_of[k3]])),
            ],
            frequent + len(names),
        )
        one = trie.find(0, np.zeros(len(o), np.int64), w[p][o])
        two = trie.find(1, one[word], v[p])
        three = trie.find(2, two[pair], u)
        top = np.full(len(o), np.log10(s.base * 0.5 / s.total))
        top[one >= 0] = trie.number(0, 0, one[one >= 0])
        below = np.full(len(o), np.log10(s.base))
        below[one >= 0] = trie.number(0, 1, one[one >= 0])
        top, below = top[word], below[word]
        top[two >= 0] = trie.number(1, 0, two[two >= 0])
        below[two >= 0] = trie.number(1, 1, two[two >= 0])
        below[w[p] == np.searchsorted(s.frequent, _END)] = np.log10(s.texts * (1 + s.pair) + s.base)  # nothing follows an end: the text's first denominator
        top = top[pair]
        top[three >= 0] = trie.number(2, 0, three[three >= 0])
        sums.append(np.bincount(doc, np.repeat(top - below[pair], length) * n, len(who)))
        yield from _sums(who, sums, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for batch in batches:
            blocks += batch.column(1).to_pylist()
        if blocks:
            yield from scored(blocks)
        release_memory()

    return run


def _most_frequent(vocabulary: DataFrame, most: int) -> np.ndarray:
    """Hashes of the words above a count that at most `most` words reach, found on a short histogram."""
    level = F.floor(F.log2("met") * 16).cast("int")
    least, many = 1 << 20, 0
    for r in sorted(vocabulary.groupBy(level.alias("level")).count().collect(), reverse=True):
        many += r["count"]
        if many > most:
            break
        least = r.level
    return vocabulary.filter(level >= least).select("word").toPandas()["word"].to_numpy(np.int64).view(np.uint64)


def language_model_scores(docs: DataFrame, learn: str, id_col: str = "doc_id", text_col: str = "text", pair: float = PAIR, base: float = BASE) -> DataFrame:
    """Score every whole text by a trigram model of the texts for which `learn`, an SQL condition on `id`, holds.

    pair and base are the weights of pairs and of unigrams against triples, both above 0.

    Tokens are lower-cased (A-Z) words and one end. Returns (id, learnt, n_tokens, n_known,
    train_tokens, base_score, score): base_score the unigram and score the trigram log10 probability
    of the text. Null and blank texts have the end as their only token. With nothing to learn from,
    every token is unknown. Rows with a null id are left out; rows that repeat an id are one
    document whose numbers are the sums of theirs. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null").withColumn("train", F.expr(learn))
    vocabulary = written(word_counts(source))
    end = F.col("word") == int(_END.astype(np.int64))
    zero = F.lit(0)
    totals = vocabulary.agg(
        F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), zero), F.coalesce(F.sum(F.when(end, F.col("n"))), zero), F.coalesce(F.sum("met"), zero)
    ).first()
    width = shuffle_width(spark)
    least = max(totals[3] / width, LEAST_HOT)
    frequent = np.unique(np.concatenate([_most_frequent(vocabulary, FREQUENT - 2), [_END, _START]]))
    hot = vocabulary.filter(F.col("met") >= least).toPandas()  # at most `width` rows
    keys = hot["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    words_hot = (keys[order], hot["n"].to_numpy(np.int64)[order])
    release(vocabulary)
    known = Shared(int(totals[1]), int(totals[0]), int(totals[2]), frequent, pair, base, [words_hot, *_hot_grams(source, words_hot[0], least)])
    shared = spark.sparkContext.broadcast(known)
    parts = 4 * width  # a shard is held whole by its task
    dealt = source.mapInArrow(_dealt(shared, parts), "part int, block binary").repartition(parts, "part")
    sums = dealt.mapInArrow(_answered(shared, width), "part int, block binary").repartition(width, "part")
    return sums.mapInArrow(_totals, "id long, n long, known long, base double, score double").select(
        "id",
        F.expr(learn).alias("learnt"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_model_scores(docs, "crc32(cast(id as string)) % 5 <> 1")
    return out.select(F.col("id").alias("doc_id"), (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
