"""Main text of web pages by a graphical model on the tree of their nodes.

Every element and every run of text is a variable, content or not. Its own potential comes from its tag, the names in class, id and
role, and its size, links, punctuation, depth and place; a table for each kind of parent and child couples the two. Sum-product messages
go upward and downward once, which on a tree gives exact marginals, for all pages of a batch level by level in numpy. The same
messages give the gradient of the likelihood of labelled pages, by which all potentials are fitted together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import Dom, parse
from .layouts import labelled_pages
from .store import small_batches, trimmed

PAGES = 900  # labelled pages that the model learns from
BATCH_CHARS = 1 << 20  # of pages whose trees are solved together
THRESHOLD = 0.5

_PUNCTUATION = str.maketrans("", "", ".,;:!?")
# Groups of numeric features and their numbers of bins.
_BINS = {"size": 16, "links": 6, "size x links": 96, "marks": 5, "share": 7, "place": 6, "depth": 12, "paragraphs": 4, "in link": 2}


@dataclass
class Forest:
    """The nodes of several pages: parents (-1 at roots), depth levels, active features as (node, feature) pairs, kinds of node."""

    parent: np.ndarray
    levels: list[np.ndarray]
    node: np.ndarray
    feature: np.ndarray
    kind: np.ndarray


class Vocabulary:
    """Numbers of tags and names; those that training did not meet share one."""

    def __init__(self, doms: list[Dom]):
        names: dict[str, int] = {}
        for dom in doms:
            for name in {n for some in dom.names for n in some}:
                names[name] = names.get(name, 0) + 1
        self.tags = {t: i + 1 for i, t in enumerate(sorted({t for dom in doms for t in dom.tag}))}
        self.names = {n: i + 1 for i, n in enumerate(sorted(n for n, c in names.items() if c > 2))}
        self.numeric = len(self.tags) + len(self.names) + 2
        self.size = self.numeric + 2 * sum(_BINS.values())

    def kinds(self, dom: Dom) -> list[int]:
        get = self.tags.get
        return [get(t, 0) for t in dom.tag]


def _totals(parent: np.ndarray, levels: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Sums over the nodes of each node's subtree."""
    out = values.astype(np.float64)
    for level in reversed(levels[1:]):
        np.add.at(out, parent[level], out[level])
    return out


def forest(doms: list[Dom], vocabulary: Vocabulary) -> Forest:
    base = np.cumsum([0] + [len(d.tag) for d in doms])
    parent = np.concatenate([np.where((p := np.array(d.parent, np.int64)) < 0, -1, p + b) for d, b in zip(doms, base)])
    kind = np.concatenate([np.array(vocabulary.kinds(d), np.int64) for d in doms])
    n = len(parent)
    page = np.repeat(np.arange(len(doms)), np.diff(base))
    depth, levels = np.zeros(n, np.int64), [base[:-1]]
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], np.arange(n + 1))
    while True:  # children of a level, all at once
        here = levels[-1]
        counts = first[here + 1] - first[here]
        if not counts.sum():
            break
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[here], counts)
        levels.append(order[at])
        depth[levels[-1]] = len(levels) - 1
    texts = [(b + i, t.strip()) for d, b in zip(doms, base) for i, t in enumerate(d.text) if t]
    chars, marks = np.zeros(n), np.zeros(n)
    where = np.array([i for i, _ in texts], np.int64)
    chars[where] = [len(t) for _, t in texts]
    marks[where] = [len(t) - len(t.translate(_PUNCTUATION)) for _, t in texts]
    is_text = kind == vocabulary.tags.get("#text", -1)
    in_link = kind == vocabulary.tags.get("a", -1)
    for level in levels[1:]:
        in_link[level] |= in_link[parent[level]]
    seen = np.cumsum(chars) - chars
    seen -= seen[base[:-1]][page]  # characters before the node on its page
    total = _totals(parent, levels, chars)
    linked = _totals(parent, levels, chars * in_link)
    marked = _totals(parent, levels, marks)
    paragraph = np.zeros(n)
    np.add.at(paragraph, np.maximum(parent, 0), (kind == vocabulary.tags.get("p", -1)) & (parent >= 0))
    whole = np.maximum(total[base[:-1]], 1)[page]
    size = np.minimum(np.log2(1 + total).astype(np.int64), 15)
    links = np.ceil(5 * linked / np.maximum(total, 1)).astype(np.int64)
    bins = {
        "size": size,
        "links": links,
        "size x links": size * 6 + links,
        "marks": np.minimum(np.ceil(60 * marked / np.maximum(total, 1)), 4).astype(np.int64),
        "share": np.minimum(np.ceil(-np.log2(np.maximum(total / whole, 1e-3))), 6).astype(np.int64),
        "place": np.minimum(6 * seen / whole, 5).astype(np.int64),
        "depth": np.minimum(depth, 11),
        "paragraphs": np.minimum(np.ceil(np.log2(1 + paragraph)), 3).astype(np.int64),
        "in link": in_link.astype(np.int64),
    }
    nodes, features, at = [np.arange(n)], [kind], vocabulary.numeric
    for name, width in _BINS.items():
        nodes.append(np.arange(n))
        features.append(at + bins[name] + width * is_text)
        at += 2 * width
    unknown = len(vocabulary.tags) + 1
    get = vocabulary.names.get
    named = [(b + i, unknown + get(name, 0)) for d, b in zip(doms, base) for i, some in enumerate(d.names) if some for name in some]
    if named:
        named = np.array(named, np.int64)
        nodes.append(named[:, 0])
        features.append(named[:, 1])
    return Forest(parent, levels, np.concatenate(nodes), np.concatenate(features), kind)


@dataclass
class TreeModel:
    """Potentials: of each feature for content, and for each kind of child and of parent a table [parent state, child state]."""

    vocabulary: Vocabulary
    own: np.ndarray
    child: np.ndarray  # kinds x 2 x 2
    above: np.ndarray

    def beliefs(self, f: Forest, pairs: bool = False):
        """(marginal of content of every node, joint marginals of parents and children where pairs)."""
        n = len(f.parent)
        local = np.zeros((n, 2))
        local[:, 1] = np.bincount(f.node, self.own[f.feature], n)
        table = self.child[f.kind] + self.above[f.kind[np.maximum(f.parent, 0)]]
        up = np.zeros((n, 2))
        for level in reversed(f.levels[1:]):  # upward: what a subtree says about its parent
            inside = table[level] + local[level][:, None, :]
            up[level] = np.logaddexp(inside[:, :, 0], inside[:, :, 1])
            np.add.at(local, f.parent[level], up[level])
        whole, joint = local.copy(), np.zeros((n, 2, 2)) if pairs else None
        for level in f.levels[1:]:  # downward: what the rest of the page says about a child
            rest = whole[f.parent[level]] - up[level]
            rest -= rest.max(1, keepdims=True)
            both = rest[:, :, None] + table[level] + local[level][:, None, :]
            whole[level] = np.logaddexp(both[:, 0], both[:, 1])
            if pairs:
                e = np.exp(both - both.max((1, 2), keepdims=True))
                joint[level] = e / e.sum((1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -50, 50))), joint


def fit(pages: list[str], rounds: int = 150, rate: float = 0.3, decay: float = 1e-5) -> TreeModel:
    """Potentials of the largest likelihood of labelled pages (see layouts.py), by gradient steps of adaptive size.

    The number of pages bounds the driver's memory: some 100 KB a page.
    """
    doms = [parse(p) for p in pages]
    vocabulary = Vocabulary(doms)
    f = forest(doms, vocabulary)
    y = []
    for dom in doms:
        state: list[bool] = []
        for parent, mark in zip(dom.parent, dom.mark):
            state.append(mark if mark is not None else parent >= 0 and state[parent])
        y += state
    y = np.array(y, np.float64)
    kinds = len(vocabulary.tags) + 1
    model = TreeModel(vocabulary, np.zeros(vocabulary.size), np.zeros((kinds, 2, 2)), np.zeros((kinds, 2, 2)))
    edge = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((len(y), 2, 2))
    seen[edge, y[f.parent[edge]].astype(int), y[edge].astype(int)] = 1
    steps = [(w, (np.zeros_like(w), np.zeros_like(w))) for w in (model.own, model.child, model.above)]
    for step in range(1, rounds + 1):
        p, joint = model.beliefs(f, pairs=True)
        short = (seen - joint)[edge]
        slopes = [np.bincount(f.feature, (y - p)[f.node], vocabulary.size), np.zeros((kinds, 2, 2)), np.zeros((kinds, 2, 2))]
        np.add.at(slopes[1], f.kind[edge], short)
        np.add.at(slopes[2], f.kind[f.parent[edge]], short)
        for (w, (first, second)), g in zip(steps, slopes):
            g = g / len(pages) - decay * w
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            w += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return model


def main_text(dom: Dom, content: np.ndarray) -> str:
    """The texts of content nodes, block by block."""
    blocks: list[list[str]] = []
    last = None
    for i in np.flatnonzero(content):
        if dom.text[i]:
            if dom.block[i] != last:
                blocks.append([])
                last = dom.block[i]
            blocks[-1].append(dom.text[i])
    return " ".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def _extracted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            pages = [p or "" for p in batch.column(2).to_pylist()]
            at = 0
            while at < len(pages):
                to, chars = at, 0
                while to < len(pages) and (to == at or chars + len(pages[to]) <= BATCH_CHARS):
                    chars += len(pages[to])
                    to += 1
                doms = [parse(p) for p in pages[at:to]]
                p, _ = model.beliefs(forest(doms, model.vocabulary))
                texts, base = [], 0
                for dom in doms:
                    texts.append(main_text(dom, p[base : base + len(dom.tag)] >= THRESHOLD))
                    base += len(dom.tag)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )
                at = to

    return run


def extract(pages: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row: the main text of its whole html, empty where there is none.

    Character references are decoded, white space inside a block becomes one space, blocks follow in page order, one space
    between. Null html is empty; repeated rows give repeated rows, null ids and addresses stay null. An empty table gives no rows.
    Other columns are ignored. The model is broadcast: potentials of the tags and names of its labelled pages.
    """
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(_extracted(shared)), f"page_id {kind}, url string, text string, n_chars long")


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), fit(labelled_pages(PAGES)))
