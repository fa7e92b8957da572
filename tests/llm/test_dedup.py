"""Line, MinHash and substring dedup against SQL and against brute force, and their edge cases."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from helpers import WORD, documents, normal, odd_rows, oracle
from pyspark.sql import functions as F

from gneiss.llm import lines, minhash, substrings


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_line_dedup_equals_sql(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    base = [[rng.choice(words) for _ in range(rng.randint(7, 12))] for _ in range(25)]
    rows = []
    for i in range(80):
        out = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at, kind = rng.randrange(len(line)), rng.randint(0, 2)
                if kind == 0:
                    line[at] = rng.choice(words)
                elif kind == 1:
                    line.insert(at, rng.choice(words))
                else:
                    del line[at]
            out.append(" ".join(line))
        rows.append((i, "\n".join(out)))
    rows += [(2000 + i, t) for i, t in odd_rows()]
    got = lines.line_dedup(documents(spark, rows)).select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
    assert normal(got.toPandas()) == oracle(lines.OP1_SQL, rows)


def test_line_dedup_by_hand(spark):
    a = "a b c d e f g h"
    rows = [(2, "x\n" + a), (1, a), (3, "a b c d e f g\nx"), (4, "a b c d E f g h i"), (5, None), (None, a)]
    got = {r.id: (r.n_lines, r.n_removed, r.text) for r in lines.line_dedup(documents(spark, rows), carry=("key",)).collect()}
    assert got == {1: (1, 0, a), 2: (2, 1, "x"), 3: (2, 1, "a b c d e f g"), 4: (1, 0, "a b c d E f g h i"), 5: (0, 0, "")}
    exact = {r.id: r.n_removed for r in lines.line_dedup(documents(spark, rows), max_edits=0).collect()}
    assert exact == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    for bad in ({"max_edits": 2}, {"min_words": 1}):
        with pytest.raises(ValueError):
            lines.line_dedup(documents(spark, rows), **bad)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = odd_rows(2)
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    linked = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(list(sets), linked)
    got = {r.id: r for r in minhash.near_duplicates(documents(spark, rows), shingle_words=k).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    if k == 4:
        frame = minhash.near_duplicates(documents(spark, rows), shingle_words=4).withColumnRenamed("id", "doc_id").toPandas()
        assert normal(frame) == oracle(minhash.OP2_SQL, rows)


def test_near_duplicate_chain_and_repeats(spark):
    """A chain of edits links its ends; rows that repeat an id are one node; null ids go."""
    words = [f"t{i}" for i in range(200)]
    rows = [(1, " ".join(words))]
    for step in range(1, 12):
        words = words[:]
        words[15 * step] = f"new{step}"
        rows.append((1 + step, " ".join(words)))
    rows += [(500, "solo text here"), (500, " ".join(words)), (None, " ".join(words))]
    got = {(r.id, r.component_id) for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == {(i, 1) for i in range(1, 13)} | {(500, 1)}


def test_sketch_estimates_similarity_and_fills(spark):
    rng = np.random.default_rng(0)
    common, own = rng.integers(0, 1 << 62, 800).astype(np.uint64), rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.sort(common), np.sort(np.concatenate([common, own])), common[:1], np.zeros(0, np.uint64)]
    s = minhash.sketch(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]), 240)
    assert (s[:3] != minhash._EMPTY).all() and (s[3] == minhash._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.1


def test_tile_links_equal_pairwise(spark):
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    rows = [(i % 2, i, i, np.sort(rng.choice(pool, 40, replace=False))) for i in range(20)]
    both = minhash._intersections([r[3] for r in rows], [r[3] for r in rows])
    assert all(both[i, j] == len(np.intersect1d(rows[i][3], rows[j][3])) for i in range(20) for j in range(20))


def test_substring_dedup_equals_sql(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 70))] for _ in range(6)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            text += [rng.choice(words) for _ in range(rng.randint(0, 15))]
            text += p[rng.randint(0, 5) : len(p) - rng.randint(0, 5)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(2000 + i, t) for i, t in odd_rows(3)]
    got = substrings.substring_dedup(documents(spark, rows))
    frame = got.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256").toPandas()
    assert normal(frame) == oracle(substrings.OP3_SQL, rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


def test_substring_dedup_edges(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage), (2, "x " + passage + " y"), (3, " ".join(["same"] * 25)), (4, passage[:-1]), (5, None), (None, passage)]
    got = {r.id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.substring_dedup(documents(spark, rows)).collect()}
    assert got == {1: (20, 0, passage), 2: (22, 20, "x y"), 3: (25, 24, "same"), 4: (20, 0, passage[:-1]), 5: (0, 0, "")}
    twice = [(1, passage), (1, passage)]
    assert [r.n_removed for r in substrings.substring_dedup(documents(spark, twice)).collect()] == [0, 0]
    with pytest.raises(ValueError):
        substrings.substring_dedup(documents(spark, rows), window=5)


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert lines.line_dedup(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert substrings.substring_dedup(empty).count() == 0


def test_hot_groups_are_joined_apart(spark):
    from gneiss.llm.skew import join_groups

    rows = spark.range(3000).select("id", F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 300).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
    got = {(r.id, r.k, r.n, r.first) for r in join_groups(rows, groups, ["k"], "n", 3000).collect()}
    assert got == {(r.id, r.k, r.n, r.first) for r in rows.join(groups, "k").collect()} and len(got) == 3000


def crowded_rows(n=120):
    """Every document holds one line that is near a hub line, one long passage, and nearly all of one text."""
    rng = random.Random(8)
    hub = [f"h{i}" for i in range(12)]
    passage = " ".join(f"p{i}" for i in range(30))
    body = [f"b{i}" for i in range(60)]
    rows = [(0, " ".join(hub))]
    for i in range(1, n):
        line, text = list(hub), list(body)
        line[rng.randrange(12)] = f"x{i}"
        text[rng.randrange(60)] = f"y{i}"
        own = " ".join(f"z{i}q{k}" for k in range(rng.randint(3, 25)))
        rows.append((i, f"{' '.join(line)}\n{own} {passage} {own[::-1]}\n{' '.join(text) if i % 2 else own}"))
    return rows


@pytest.mark.parametrize("least", [2, 1000])
def test_crowded_keys_are_joined_apart_without_loss(spark, monkeypatch, least):
    from gneiss.llm import skew

    monkeypatch.setattr(skew, "LEAST", least)  # from how many rows a group is broadcast
    monkeypatch.setattr(minhash, "TILE", 8)
    rows = crowded_rows()
    got = normal(substrings.substring_dedup(documents(spark, rows)).drop("kept_text").withColumnRenamed("id", "doc_id").toPandas())
    assert got == oracle(substrings.OP3_SQL, rows)
    out = lines.line_dedup(documents(spark, rows)).select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
    assert normal(out.toPandas()) == oracle(lines.OP1_SQL, rows)
    near = [(i, " ".join(t.split("\n")[-1].split())) for i, t in rows]
    pairs = minhash.near_duplicates(documents(spark, near), shingle_words=4, percent=80).withColumnRenamed("id", "doc_id")
    assert normal(pairs.toPandas()) == oracle(minhash.OP2_SQL, near)
