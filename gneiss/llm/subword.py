"""Subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the word itself, each
hashed to one of a fixed number of buckets. A window's vector is the mean of its words', and a
linear softmax reads it. Embeddings and softmax are trained together, so a word never seen in
training still has the vectors of the n-grams it shares with words that were.

A text is its consecutive windows. With pool="mean" all windows count alike; with pool="max" the
class margin of the text is the largest of its windows, so one passage decides a long text (in
training a smooth maximum, which all windows feel). There the bias is fixed at BASE_RATE: a text of
which training knows nothing scores that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .text import Slice, lowered, range_hashes, slices, word_ranges

SCORED_BYTES = 1 << 18  # text scored at once: n-grams take a hundred times its memory
SHARPNESS = 2.0  # of the smooth maximum
BASE_RATE = 0.1


@dataclass
class Bag:
    """Distinct words of a slice as bucket ids, and the word of every token."""

    grams: np.ndarray
    word: np.ndarray  # of each gram, in no order
    token: np.ndarray
    rows: np.ndarray  # bounds of each text's tokens
    words: int

    def means(self, values: np.ndarray) -> np.ndarray:
        """Mean over each word's grams of rows of values."""
        sizes = np.bincount(self.word, minlength=self.words)
        return np.stack([np.bincount(self.word, v, self.words) for v in values.T], 1) / sizes[:, None]


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int, least: int = 3, most: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram of the given words and of each word itself, in no order."""
    # The words end to end, each between marks that no text byte equals.
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 2)])
    text = np.zeros(to[-1], np.uint16)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(to[:-1] + 1, size) + inside] = data[np.repeat(starts, size) + inside]
    text[to[:-1]], text[to[1:] - 1] = 300, 301
    lo, hi, word = [to[:-1]], [to[1:]], [np.arange(len(starts))]
    for n in range(least, most + 1):
        count = np.maximum(size + 2 - n + 1, 0)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(to[:-1], count)
        lo.append(at)
        hi.append(at + n)
        word.append(np.repeat(np.arange(len(starts)), count))
    h = range_hashes(text, np.concatenate(lo), np.concatenate(hi))
    return (h & np.uint64(buckets - 1)).astype(np.int64), np.concatenate(word)


def bag(part: Slice, buckets: int) -> Bag:
    starts, ends, rows = word_ranges(part)
    if not len(starts):
        return Bag(*(np.zeros(0, np.int64) for _ in range(3)), rows, 0)
    data = lowered(part.data)
    _, first, token = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return Bag(*_grams(data, starts[first], ends[first], buckets), token, rows, len(first))


class Sample:
    """The texts of a training sample, hashed once: each distinct word's grams, each text's words by number."""

    def __init__(self, texts: list[str], buckets: int):
        known: dict[int, int] = {}
        grams, sizes, tokens, counts = [], [], [], []
        for part in slices(pa.array(texts, pa.string())):
            starts, ends, rows = word_ranges(part)
            data = lowered(part.data)
            u, first, inverse = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
            new = np.array([h not in known for h in u.tolist()], bool)
            known.update(zip(u[new].tolist(), range(len(known), len(known) + int(new.sum()))))
            g, word = _grams(data, starts[first[new]], ends[first[new]], buckets)
            grams.append(g[np.argsort(word, kind="stable")].astype(np.int32))
            sizes.append(np.bincount(word, minlength=int(new.sum())))
            tokens.append(np.array([known[h] for h in u.tolist()], np.int32)[inverse])
            counts.append(np.diff(rows))
        self.grams, self.tokens = np.concatenate(grams), np.concatenate(tokens)
        self.gram_at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def bag(self, pick: np.ndarray) -> Bag:
        """The bag of some of the texts."""
        ids, counts = _ranges(self.token_at, pick)
        words, token = np.unique(self.tokens[ids], return_inverse=True)
        ids, sizes = _ranges(self.gram_at, words)
        return Bag(self.grams[ids].astype(np.int64), np.repeat(np.arange(len(words)), sizes), token, np.concatenate([[0], np.cumsum(counts)]), len(words))


def _ranges(at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at[i] to at[i + 1] for each i of pick, end to end, and how many there are of each."""
    counts = at[pick + 1] - at[pick]
    return np.arange(counts.sum()) + np.repeat(at[pick] - np.cumsum(counts) + counts, counts), counts


def window_bounds(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token of each window, windows of each text); a text's last window may be shorter."""
    counts = -(-np.diff(rows) // width)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(rows[:-1], counts) + at * width, counts


@dataclass
class Model:
    """The trained classifier, folded to one score for each bucket and class: its size is fixed."""

    scores: np.ndarray  # buckets x classes
    bias: np.ndarray
    window: int
    pool: str

    def logits(self, part: Slice) -> np.ndarray:
        """One row of class logits for each text; a text without words has the bias alone."""
        b = bag(part, len(self.scores))
        out = np.tile(self.bias, (len(part), 1)).astype(np.float64)
        if not len(b.token):
            return out
        word = b.means(self.scores[b.grams])
        at, counts = window_bounds(b.rows, self.window if self.pool == "max" else 1 << 60)
        sums = np.add.reduceat(word[b.token], at)
        sums /= np.diff(np.append(at, len(b.token)))[:, None]
        some = counts > 0
        first = (np.cumsum(counts) - counts)[some]
        if self.pool == "mean":
            out[some] += sums
            return out
        margin = sums[:, 1] - sums[:, 0]
        out[some, 1] += np.maximum.reduceat(margin, first)
        return out

    def probabilities(self, part: Slice) -> np.ndarray:
        z = self.logits(part)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(
    texts: list[str],
    labels: np.ndarray,
    classes: int,
    pool: str = "mean",
    buckets: int = 1 << 18,
    size: int = 8,
    window: int = 3,
    epochs: int = 4,
    batch: int = 64,
    rate: float = 0.15,
    seed: int = 7,
) -> Model:
    """Fit by stochastic gradient descent with per-coordinate step sizes, classes weighted alike in each batch."""
    if not len(texts):
        return Model(np.zeros((buckets, classes), np.float32), np.zeros(classes), window, pool)  # knows nothing at all
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 1 / size, (buckets, size)).astype(np.float32)
    W = rng.normal(0, 1 / np.sqrt(size), (size, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    if pool == "max":
        bias[1] = np.log(BASE_RATE / (1 - BASE_RATE))
    gE, gW, gb = np.full(buckets, 1e-6, np.float64), np.full_like(W, 1e-6), np.full_like(bias, 1e-6)
    labels = np.asarray(labels)
    scale = 20.0  # a mean over many n-grams is short; keeps a window's vector of ordinary length

    def rate_now(step: int, steps: int) -> float:
        return rate * (1 - 0.9 * step / steps)

    steps = max(1, epochs * -(-len(texts) // batch))
    done = 0
    sample = Sample(texts, buckets)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            y = labels[pick]
            b = sample.bag(pick)
            full = np.flatnonzero(np.diff(b.rows) > 0)
            if not len(full):
                continue
            ids, where = np.unique(b.grams, return_inverse=True)
            e = E[ids]
            grams = np.bincount(b.word, minlength=b.words)
            word = b.means(e[where])
            starts, counts = window_bounds(b.rows, window if pool == "max" else 1 << 60)
            tokens = np.diff(np.append(starts, len(b.token)))
            x = np.add.reduceat(word[b.token], starts) / tokens[:, None] * scale
            counts = counts[full]
            first = np.cumsum(counts) - counts
            z = x @ W
            if pool == "max":
                m = z[:, 1] - z[:, 0]
                top = np.maximum.reduceat(m, first)
                lift = np.exp(SHARPNESS * (m - np.repeat(top, counts)))
                total = np.add.reduceat(lift, first)
                share = lift / np.repeat(total, counts)
                logit = np.stack([np.zeros(len(full)), top + np.log(total) / SHARPNESS], 1) + bias
            else:
                logit, share = z + bias, None
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            weight = np.ones(len(full))
            present = np.bincount(y[full], minlength=classes)
            if pool == "mean":
                weight = len(full) / (np.count_nonzero(present) * present[y[full]])
            g = p.copy()
            g[np.arange(len(full)), y[full]] -= 1
            g *= weight[:, None] / len(full)
            if pool == "max":
                gz = np.repeat(g[:, 1], counts) * share
                gz = np.stack([-gz, gz], 1)
            else:
                gz = g
            dW = x.T @ gz
            dx = (gz @ W.T) / tokens[:, None] * scale
            owner = np.repeat(np.arange(len(starts)), tokens)
            dword = np.stack([np.bincount(b.token, dx[owner, j], b.words) for j in range(size)], 1) / grams[:, None]
            dgram = dword[b.word]
            de = np.stack([np.bincount(where, dgram[:, j], len(ids)) for j in range(size)], 1).astype(np.float32)
            step = rate_now(done, steps)
            gE[ids] += (de**2).mean(1)
            E[ids] -= step * de / np.sqrt(gE[ids])[:, None]
            gW += dW**2
            W -= (step * dW / np.sqrt(gW)).astype(np.float32)
            if pool == "mean":
                db = g.sum(0)
                gb += db**2
                bias -= (step * db / np.sqrt(gb)).astype(np.float32)
            done += 1
    E[gE <= 1e-6] = 0  # n-grams that training never met say nothing
    return Model((E @ W * scale).astype(np.float32), bias.astype(np.float64), window, pool)
