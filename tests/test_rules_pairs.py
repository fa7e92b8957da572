"""Reviews of alternatives and overlap candidates against brute force, on groups too large for pairs of rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gneiss.operators import pairs, rules


def states(rows):
    out = {}
    for s, i, *m, bad in rows:
        others = [r for r in rows if r[0] == s and r[1] != i and not r[-1]] if not bad and None not in m else []
        others = [(r[1], r[2:-1]) for r in others if None not in r[2:-1]]
        m = tuple(m)
        twin = any(o == m and j < i for j, o in others)
        beaten = any(all(x <= y for x, y in zip(o, m)) and o != m for _, o in others)
        out[s, i] = "invalid" if bad else "indistinguishable" if twin else "dominated" if beaten else "viable"
    return out


@pytest.mark.parametrize("measures", [["a"], ["a", "b"], ["a", "b", "c"]])
def test_reviewed_against_all_pairs(spark, measures):
    rng = random.Random(len(measures))
    rows = [(i % 3, i, *[rng.choice([None, *range(6)]) for _ in measures], rng.random() < 0.2) for i in range(90)]
    df = spark.createDataFrame(rows, "subject int, id int, " + ", ".join(f"{m} int" for m in measures) + ", bad boolean")
    assert {(r.subject, r.id): r.state for r in rules.reviewed(df, measures, "bad", "id").collect()} == states(rows)


def test_reviewed_of_one_large_subject(spark):
    """40,000 alternatives are 1.6 thousand million pairs, which were all joined."""
    began = time.time()
    df = spark.range(40_000).select(F.lit(1).alias("subject"), "id", (F.col("id") % 100).alias("a"), (99 - F.col("id") % 100).alias("b"), F.lit(False).alias("bad"))
    got = {r.state: r.n for r in rules.reviewed(df, ["a", "b"], "bad", "id").groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert got == {"viable": 100, "indistinguishable": 39_900}
    assert time.time() - began < 100


def test_overlap_candidates_against_all_pairs(spark, monkeypatch):
    """Tiles of a few items, an item in two files, coupling both ways and within a file; temporal pairs are not shuffled."""
    monkeypatch.setattr(pairs, "TILE", 4)
    rng = random.Random(3)
    items = [(i, i % 5, [f"t{rng.randrange(30)}"], [f"p{rng.randrange(12)}" for _ in range(5)]) for i in range(60)] + [(7, 4, ["t1"], ["p1"]), (8, None, [], []), (8, 3, [], [])]
    turned = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
    coupled = [(0, 1), (1, 0), (2, 2), (4, 3), (0, 4), (4, 2), (0, 1)]
    df = spark.createDataFrame(items, "item int, file int, tokens array<string>, properties array<string>")
    args = df, spark.createDataFrame(turned, "item int, other int"), spark.createDataFrame(coupled, "left int, right int")
    want = {}
    for (x, f), (y, g) in [((a[0], a[1]), (b[0], b[1])) for a in items for b in items]:
        if x < y and ((f, g) in coupled or (g, f) in coupled):
            want.setdefault((x, y), set()).add("temporal")
    for kind, column, least in (("name", "tokens", 1), ("property", "properties", 3)):
        for r in pairs.candidates(df, "item", column, least).collect():
            want.setdefault((r.left, r.right), set()).add(kind)
    for x, y in turned:
        if x != y:
            want.setdefault((min(x, y), max(x, y)), set()).add("conversion")
    got = [tuple(r) for r in pairs.overlap_candidates(*args).collect()]
    assert sorted(got) == sorted((*k, ",".join(sorted(v))) for k, v in want.items())


def test_overlap_candidates_take_few_bytes_a_pair(spark, tmp_path):
    """Two coupled files of 1,500 items are 2.25 million rows, which took over 2 bytes each where they are written."""
    ids = random.Random(5).sample(range(100_000), 3000)
    df = spark.createDataFrame([(x, i % 2, [], []) for i, x in enumerate(ids)], "item long, file int, tokens array<string>, properties array<string>")
    turned = spark.createDataFrame([(ids[0], ids[1])], "item long, other long")
    out = pairs.overlap_candidates(df, turned, spark.createDataFrame([(0, 1)], "left int, right int"))
    out.write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.select("left", "right").distinct().count() == 1500 * 1500
    assert [tuple(r) for r in got.filter("generators <> 'temporal'").collect()] == [(min(ids[:2]), max(ids[:2]), "conversion,temporal")]
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 1500 * 1500 * 0.5


@pytest.mark.parametrize("tiles", [2, 64])
def test_overlap_candidates_of_a_hub(spark, monkeypatch, tiles):
    """A file coupled with itself and with many small ones, in small tiles and blocks; conversions have a wider type than items."""
    for name, value in (("TILE", 4), ("TILES", tiles), ("BLOCK", 3)):
        monkeypatch.setattr(pairs, name, value)
    rng = random.Random(tiles)
    files = {i: 0 if i < 30 else i - 29 if i < 45 else 20 for i in rng.sample(range(50), 50)}
    coupled = [(0, f) if f % 2 else (f, 0) for f in range(1, 16)] + [(0, 0), (0, 20), (20, 20)]
    turned = [(rng.randrange(50), rng.randrange(50)) for _ in range(300)]
    items = spark.createDataFrame([(i, f, [], []) for i, f in files.items()], "item int, file int, tokens array<string>, properties array<string>")
    ways = {*coupled, *((g, f) for f, g in coupled)}
    want = {(x, y): "temporal" for x in files for y in files if x < y and (files[x], files[y]) in ways}
    for x, y in turned:
        if x != y:
            pair = min(x, y), max(x, y)
            want[pair] = "conversion,temporal" if want.get(pair, "conversion") != "conversion" else "conversion"
    got = [tuple(r) for r in pairs.overlap_candidates(items, spark.createDataFrame(turned, "item long, other long"), spark.createDataFrame(coupled, "left int, right int")).collect()]
    assert sorted(got) == sorted((*k, v) for k, v in want.items())
