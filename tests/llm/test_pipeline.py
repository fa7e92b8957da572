"""The pipeline stage by stage, and the subpackage's independence."""

import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from helpers import WORD, documents, odd_rows
from test_models import labelled

import corpus_pipeline
from gneiss.llm import queries

ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = labelled(spark, 300)
    rows += [(400 + i, t) for i, t in odd_rows()] + [(2000, rows[1][1]), (2001, rows[1][1] + " extra")]
    path = str(tmp_path_factory.mktemp("sf"))
    frame = pd.DataFrame(rows, columns=["doc_id", "text"]).assign(lang="en", source="s", n_chars=lambda f: f.text.fillna("").str.len())
    frame.to_parquet(f"{path}/documents.parquet")
    labels.toPandas().to_parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.toPandas()
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        now = docs.toPandas()
        seen.append(name)
        if name != "best_fit_packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert set(now.doc_id) <= set(before.doc_id)
        if name == "toxicity":
            gone = set(before.doc_id) - set(now.doc_id)
            assert np.mean([i % 3 == 0 for i in gone if i < 300]) > 0.95 and len([i for i in gone if i < 300]) > 90
            assert not any(g >= 400 for g in gone)
        if name == "line_dedup":
            assert (now.n_chars == now.text.str.len()).all()
            assert 2000 not in set(now.doc_id) and {1, 901 + 400} <= set(now.doc_id)
        if name == "minhash_near_dedup":
            sets = {r.doc_id: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := WORD.findall(r.text.lower())) else set() for r in now.itertuples()}
            ids = sorted(sets)
            assert not any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b and sets[a] and sets[b])
        if name == "best_fit_packing":
            assert set(now.doc_id) == set(before.doc_id)
        before = now
    assert len(seen) == 5


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)


def test_rest_does_not_need_the_subpackage():
    """The library imports nothing from llm; __spark_entry__ works without it."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('gneiss.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'churn_by_subject' in e.queries() and 'pipeline' not in e.queries() and not any(k.startswith('op1') for k in e.oracle_sql())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": ROOT})


def test_empty_documents(spark, tmp_path):
    empty = documents(spark, []).selectExpr("doc_id", "text", "key as lang", "key as source", "n_chars")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
