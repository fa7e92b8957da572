"""Hard negatives against a plain search of every pair."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from helpers import normal

from gneiss.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id string, q string, anchor int, w int, score string, norm int, rank string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def frame(spark, rows):
    """rows of (vec_id, embedding, label) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], label, "x", "y", 1, 2, "s", 3, "r") for i, v, label in rows], SCHEMA)


def plain(rows, positives=5, negatives=10, low=30, high=90, every=100):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, label, q in sorted(good, key=lambda r: (r[0], r[1], np.array(r[2], "<i4").tobytes())):
        if i % every == 0:
            anchors.setdefault(i, (label, q))
    out = []
    for a, (label, q) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(q, r)), i, other) for i, other, r in good if len(r) == len(q))
        best = [(i, -s) for s, i, other in scored if other == label and i != a][:positives]
        for p, ps in best:
            found = [(i, -s) for s, i, other in scored if other != label and low * ps <= -100 * s <= high * ps][:negatives]
            out += [(a, p, rank, i, ps, s) for rank, (i, s) in enumerate(found, 1)]
    return normal(pd.DataFrame(out, columns=COLUMNS))


def vectors(seed, n=400, size=6, labels=3, round_to=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 0.5) for _ in range(size)]
        if round_to:
            v = [round(x * round_to) / round_to for x in v]
        rows.append((i, v, rng.randrange(labels)))
    return rows


@pytest.mark.parametrize("seed,round_to", [(1, None), (2, 2), (3, 1)])
def test_equals_plain_search(spark, seed, round_to):
    """round_to makes many equal scores, so that ids decide."""
    rows = vectors(seed, round_to=round_to)
    got = negatives.hard_negatives(frame(spark, rows))
    assert got.columns == COLUMNS and normal(got.toPandas()) == plain(rows)


def test_large_groups_of_copies(spark):
    """Hundreds of equal vectors on either side, over ids far apart: the id's digits decide."""
    rows = vectors(4, 60) + [(1000 + 7919 * i, [0.5, 0.25, 0, 0, 0, -0.125], i % 2) for i in range(900)]
    rows += [(-(1 << 62), [0.5, 0.25, 0, 0, 0, -0.125], 0), ((1 << 62) - 2, [0.5, 0.25, 0, 0, 0, -0.125], 1), (100, [1.0, 0.5, 0.25, 0, 0, 0], 0), (200, [0.9, 0.4, 0.25, 0, 0, 0], 1)]
    rng = random.Random(1)
    rng.shuffle(rows)
    assert normal(negatives.hard_negatives(frame(spark, rows)).toPandas()) == plain(rows)


def test_odd_rows(spark):
    rows = vectors(5, 130) + [(i, [0.1 * (i % 3), 0.2], i % 2) for i in range(200, 320)]
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 1), (500, [0.1] * 6, None), (None, [0.1] * 6, 1), (600, [0.1, None, 0, 0, 0, 0], 1), (700, [nan] + [0.1] * 5, 1), (701, [inf] + [0.1] * 5, 1)]
    rows += [(800, [0.0] * 6, 1), (900, [], 1), (901, [], 1), (902, [], 2), (1000, [0.3], 1)]
    rows += [(100, rows[100][1], rows[100][2]), (100, [0.7] * 6, 2), (7, [0.7] * 6, 2), (7, [0.7] * 6, 2)]
    assert normal(negatives.hard_negatives(frame(spark, rows)).toPandas()) == plain(rows)


def test_blocks_and_other_limits(spark, monkeypatch):
    rows = vectors(6, 300, labels=2)
    monkeypatch.setattr(negatives, "BLOCK", 8)
    got = negatives.hard_negatives(frame(spark, rows), anchors_where="id % 10 = 0", positives=2, negatives=64, low=0, high=200)
    assert normal(got.toPandas()) == plain(rows, 2, 64, 0, 200, 10)


def test_refuses_what_is_not_exact(spark):
    with pytest.raises(Exception, match="no exact integer products"):
        negatives.hard_negatives(frame(spark, [(1, [1e6], 1)]), scale=1 << 20).count()
    with pytest.raises(ValueError, match="from 1 to"):
        negatives.hard_negatives(frame(spark, []), positives=0)


def test_empty_table(spark):
    assert negatives.hard_negatives(frame(spark, [])).count() == 0
    assert negatives.hard_negatives(frame(spark, [(1, [0.5], 1), (2, [0.5], 2)])).count() == 0
