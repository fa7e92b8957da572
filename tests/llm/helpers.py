"""Small documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, id string, line int, key string, path double, n long, score string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """rows of (doc_id, text) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "k", 0.5, 7, "s", 3) for i, t in rows], SCHEMA)


def odd_rows(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(n):
        rows.append((i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 4)))))
    for i in range(0, n, 5):
        text = rows[i][1].split(" ")
        text[rng.randrange(len(text))] = "edited"
        rows.append((n + i, " ".join(text)))
    rows += [(900, None), (901, ""), (902, " \t\n \x0b"), (903, "one"), (904, "one"), (905, "same " * 3000), (906, "naïve Ünïcode word ünïcode")]
    rows += [(907, rows[0][1]), (908, rows[0][1].upper())]
    return rows


def oracle(sql, rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    return normal(con.sql(sql).df())


def normal(frame):
    columns = sorted(frame.columns)
    return sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


def result(df, **renames):
    for a, b in renames.items():
        df = df.withColumn(b, F.col(a)).drop(a)
    return normal(df.toPandas())
