"""Phrase collocations against a plain count of every run and against their SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from helpers import normal, odd_rows

from gneiss.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, f long, n long, words int, rank long, k int"


def docs(spark, rows):
    """rows of (doc_id, text, lang) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, 3, 4, 5) for i, t, lang in rows], SCHEMA)


def plain(rows, max_words, least, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {}
    frequent = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, p), a in frequent.items():
        inside = any(
            other == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (other, q), b in frequent.items()
        )
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = []
    for lang, group in found.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(group)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return normal(pd.DataFrame(out, columns=["lang", "rank", "phrase", "a", "l", "r", "n", "score"]))


def rows_of(seed):
    rng = random.Random(seed)
    words = ["a", "B", "ç", "dé", "Ünï", "f g", "\U0001f600", "x-1", "long" * 20]
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", "\x0b", "\x0c", "\r\n"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words[: rng.randint(2, 9)]) + rng.choice(marks) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    rows += [(i, t, "en") for i, t in odd_rows()]
    rows += [(500, None, "en"), (501, "", None), (502, " ., \n", "fr"), (None, "a b a b", "de"), (1, "a b a b", "de"), (1, "a b a b", "de")]
    rows += [(600, "one two three. " * 9, "es"), (601, "w", "es")]
    return rows


@pytest.mark.parametrize("seed,max_words,least,top", [(1, 5, 3, 2000), (2, 4, 8, 7), (3, 2, 5, 50), (4, 3, 1, 100)])
def test_equals_plain_counts(spark, seed, max_words, least, top):
    rows = rows_of(seed)
    got = phrases.collocations(docs(spark, rows), max_words, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert normal(got.toPandas()) == plain(rows, max_words, least, top)


def test_equals_sql(spark):
    rows = rows_of(7) * 4
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang"]))
    assert normal(phrases.collocations(docs(spark, rows)).toPandas()) == normal(con.sql(phrases.OP11_SQL).df())


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """A filter too small for the frequent runs lets all through; the counts still decide."""
    rows = rows_of(5)
    want = normal(phrases.collocations(docs(spark, rows), 4, 3).toPandas())
    monkeypatch.setattr(phrases, "FILTER_BITS", 1)
    monkeypatch.setattr(phrases, "_filter", lambda frequent, count: phrases.RunFilter(np.full(64, ~np.uint64(0), np.uint64)))
    assert normal(phrases.collocations(docs(spark, rows), 4, 3).toPandas()) == want


def test_text_beyond_a_chunk(spark):
    """One text of several chunks' size, and products beyond 64 bits."""
    rows = [(1, "alpha beta gamma " * 300_000, "en"), (2, "alpha beta", "en")]
    got = phrases.collocations(docs(spark, rows)).toPandas()
    n = 900_002
    top = got[got.phrase == "alpha beta gamma alpha beta"].iloc[0]
    assert top.a == 299_999 and top.n == n and top.score == 1000 * top.a * n // (top.l * top.r)
    assert "alpha beta" in set(got.phrase) and "beta gamma alpha beta" not in set(got.phrase)


def test_large_counts_are_exact(spark):
    frame = spark.createDataFrame([(10**15 + 7, 10**16 + 1, 10**15 + 9, 10**15 + 8)], "a long, n long, l long, r long")
    got = frame.selectExpr("cast(1000 * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0)) as decimal(38, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0))) as score").first().score
    assert got == 1000 * (10**15 + 7) * (10**16 + 1) // ((10**15 + 9) * (10**15 + 8))


def test_empty_table(spark):
    assert phrases.collocations(docs(spark, [])).count() == 0
