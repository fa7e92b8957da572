"""Scalar functions, ranks and small rules on hand-made rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gneiss.functions import scalar, stats
from gneiss.operators import metering, pairs, rollup, rules, sets


def one(spark, column, **values):
    names, row = list(values), tuple(values.values())
    df = spark.createDataFrame([row], names) if names else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_ratios(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 4)], "a int, b int")
    got = df.select(stats.ratio(F.col("a"), F.col("b")).alias("r"), stats.ratio_or_null(F.col("a"), F.col("b")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5), (0.0, None), (None, None)]


def test_strict_rank_is_not_percent_rank(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 9), ("b", 5)], "k string, v int")
    got = stats.with_strict_rank(df, "v", ["k"], "r").collect()
    assert sorted((r.k, r.v, r.r) for r in got) == [("a", 1, 0.0), ("a", 1, 0.0), ("a", 2, 0.5), ("a", 9, 0.75), ("b", 5, 0.0)]


def test_nearest_rank(spark):
    df = spark.range(10).withColumnRenamed("id", "v")
    got = df.agg(*stats.distribution("v")).first()
    assert tuple(got) == (9, 4, 8, 9)
    assert tuple(df.filter("v > 50").agg(*stats.aggregate("v")).first()) == (0, 0.0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        stats.distribution("v", "none")


@pytest.mark.parametrize("name, tokens", [("parseHTTPResponse", ["parse", "http", "response"]), ("snake_case2X", ["snake", "case2", "x"]), ("", [])])
def test_identifier_tokens(spark, name, tokens):
    assert one(spark, scalar.identifier_tokens(F.col("n")), n=name) == tokens


@pytest.mark.parametrize("text, ms", [("250ms", 250), ("30s", 30000), ("2w", 1209600000), ("5x", None), ("", None), ("m5", None)])
def test_durations(spark, text, ms):
    assert one(spark, scalar.duration_ms(F.col("t")), t=text) == ms


@pytest.mark.parametrize("ms, text", [(86400000, "1d"), (7200000, "2h"), (90000, "90s"), (1, "1ms"), (0, "0ms")])
def test_cadence(spark, ms, text):
    assert one(spark, scalar.cadence(F.col("m")), m=ms) == text


@pytest.mark.parametrize("a, b, n", [("a/b", "a/c", 2), ("a/b", "a/b", 0), ("a", "a/b/c", 2), ("", "x", 1), ("a/b/c", "d", 4)])
def test_directory_distance(spark, a, b, n):
    assert one(spark, scalar.directory_distance(F.col("a"), F.col("b")), a=a, b=b) == n


@pytest.mark.parametrize("spec, package", [("react", "react"), ("react/dom", "react"), ("@a/b/c", "@a/b"), ("./x", None), ("/x", None), ("#x", None), ("node:fs", None), ("@a", None)])
def test_package_of(spark, spec, package):
    assert one(spark, scalar.package_of(F.col("s")), s=spec) == package


def test_file_kinds_and_extensions(spark):
    df = spark.createDataFrame([("a/vite.config.ts",), ("a/x.test.ts",), ("a/b.stories.tsx",), ("a/b.ts",), ("a/.env",), ("a/x.",), ("README.MD",)], "p string")
    got = df.select(scalar.file_kind(F.col("p")).alias("k"), scalar.extension(F.col("p")).alias("e")).collect()
    assert [tuple(r) for r in got] == [("config", "ts"), ("test", "ts"), ("story", "tsx"), ("source", "ts"), ("config", None), ("other", None), ("other", "md")]
    kinds = {
        "package.json": "config", "a/tsconfig.build.json": "config", "a/data.json": "other", "a/x.toml": "other", "a/.eslintrc": "config", "a/config.ts": "source", "e2e/a.ts": "test", "a/__mocks__/b.js": "test",
        "stories/a.ts": "story", "a/x.spec.mjs": "test", "a/x.stories.js": "story", "test": "other", "a/x.config.cts": "config", "a/tests/x.md": "test", "a/b.cjsx": "source", "latest/a.ts": "source",
    }
    df = spark.createDataFrame([(k,) for k in kinds], "p string")
    assert {r.p: r.k for r in df.select("p", scalar.file_kind(F.col("p")).alias("k")).collect()} == kinds


def test_covers(spark):
    df = spark.createDataFrame([("a/b", "a/b/c"), ("a/b", "a/bc"), ("a/b", "a/b"), ("a/b#x", "a/b#x/y")], "f string, p string")
    assert [r.x for r in df.select(scalar.covers(F.col("f"), F.col("p")).alias("x")).collect()] == [True, False, True, False]


def test_patch_and_tags(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"}, ["x", "y"])], "m map<string,string>, p map<string,string>, t array<string>")
    got = df.select(scalar.patched(F.col("m"), F.col("p")).alias("m"), scalar.has_tags(F.col("t"), ["x"], ["z", "y"]).alias("a"), scalar.has_tags(F.col("t"), ["z"]).alias("b")).first()
    assert got.m == {"a": "1", "c": "3"} and got.a and not got.b


def naive_glob(glob, path):
    """Alternatives expanded first, then matched character by character."""
    if (m := re.search(r"\{([^{}]*)\}", glob)) is not None:
        return any(naive_glob(glob[: m.start()] + o + glob[m.end() :], path) for o in m[1].split(","))

    def at(i, j):
        if i == len(glob):
            return j == len(path)
        if glob.startswith("**/", i):
            k = path.find("/", j)
            return at(i + 3, j) or (k > j and at(i, k + 1))
        if glob.startswith("**", i):
            return any(at(i + 2, k) for k in range(j, len(path) + 1))
        if glob[i] == "*":
            k = j
            while True:
                if at(i + 1, k):
                    return True
                if k == len(path) or path[k] == "/":
                    return False
                k += 1
        return j < len(path) and (glob[i] == path[j] or (glob[i] == "?" and path[j] != "/")) and at(i + 1, j + 1)

    return at(0, 0)


def test_globs_against_a_naive_matcher():
    rng = random.Random(11)
    for _ in range(3000):
        glob = "".join(rng.choice(["a", "b", "/", "*", "**", "**/", "?", "{a,b/}", "."]) for _ in range(rng.randint(1, 5)))
        path = "".join(rng.choice("ab/.") for _ in range(rng.randint(0, 6)))
        assert bool(re.match(scalar.glob_pattern(glob), path)) == naive_glob(glob, path), (glob, path)


GLOBS = [
    ("**/{A,B}.md", "A.md", True), ("**/{A,B}.md", "x/y/B.md", True), ("**/{A,B}.md", "x/y/C.md", False), ("*.md", "d/R.md", False), ("docs/**", "docs/a/b.txt", True), ("src/**/i.ts", "src/i.ts", True),
    ("f?.ts", "f1.ts", True), ("f?.ts", "f12.ts", False), ("f?.ts", "f/.ts", False), ("*.{js,{ts,tsx}}", "a.tsx", True), ("*.{js,{ts,tsx}}", "a.css", False), ("{literal}", "{literal}", True), ("{literal}", "literal", False),
    ("a{b", "a{b", True), ("a}b", "a}b", True), ("a,b", "a,b", True), ("a[0]+(b).ts", "a[0]+(b).ts", True), ("a[0]+(b).ts", "a0b.ts", False), ("*.md", "R.md.bak", False), ("", "", True), ("**", "a\nb", False), ("a", "a\n", False),
]


def test_globs_by_case(spark):
    for glob, path, matches in GLOBS:
        assert bool(re.match(scalar.glob_pattern(glob), path)) == matches, (glob, path)
    df = spark.createDataFrame([(p,) for p in {p for _, p, _ in GLOBS}], "p string")
    for glob in {g for g, _, _ in GLOBS}:
        got = {r.p: r.m for r in df.select("p", scalar.matches_glob(F.col("p"), glob).alias("m")).collect()}
        assert all(got[p] == m for g, p, m in GLOBS if g == glob)


def test_durations_slots_and_limits(spark):
    df = spark.createDataFrame([("30m", "1.5h", "250ms"), ("0s", "2w", "7d"), ("x", "3s", "1.5s")], "a string, b string, c string")
    got = df.select(*[scalar.wave_ms(F.col(c), g).cast("long").alias(c) for c, g in (("a", "cadence"), ("b", "span"), ("c", "delay"))]).collect()
    assert [tuple(r) for r in got] == [(1_800_000, 5_400_000, 250), (None, 1_209_600_000, None), (None, None, 1500)]
    df = spark.sql("select timestamp'2024-03-15 10:30:00' as t")  # a Friday
    slot = lambda *a: str(df.select(scalar.next_slot(F.col("t"), *a).alias("x")).first().x)
    assert slot(11) == "2024-03-15 11:00:00" and slot(10, 30) == "2024-03-16 10:30:00" and slot(9, 0, ["fri"]) == "2024-03-22 09:00:00" and slot(9, 5, ["mon", "wed"]) == "2024-03-18 09:05:00"
    back = lambda r: str(df.select(scalar.range_start(F.lit(r), F.col("t")).alias("x")).first().x)
    assert (back("1y"), back("6m"), back("30d"), back("all")) == ("2023-03-15 10:30:00", "2023-09-15 10:30:00", "2024-02-14 10:30:00", "None")


def test_formats(spark):
    df = spark.createDataFrame([(0.5, 1234), (0.00001, 999), (12.345000001, 2_500_000), (0.0, 0)], "m double, n long")
    got = df.select(scalar.money(F.col("m")).alias("m"), scalar.short_count(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("$0.5000", "1.2k"), ("<$0.0001", "999"), ("$12.35", "2.5M"), ("$0.0000", "0")]
    df = spark.createDataFrame([(5.125, 1650), (1.005, 1250), (1234.5, 1_250_000)], "m double, n long")
    got = df.select(scalar.money(F.col("m"), F.lit("EUR")).alias("m"), scalar.short_count(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("5.13 EUR", "1.6k"), ("1.00 EUR", "1.3k"), ("1234.50 EUR", "1.3M")]
    texts = ['{"a": 1}', '{"a": -0}', '{"a": "-0"}', "{", "[1e9999]", "-0.5", "null", '{"a":-0.0}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(scalar.valid_json(F.col("t")).alias("x")).collect()] == [True, False, True, False, False, True, True, False]
    df = spark.createDataFrame([("---\nname: a b\nkind: c\n---\nHello {{ who }} and {{who}} {{x.y}}",), ("none",)], "t string")
    got = df.select(scalar.frontmatter(F.col("t")).alias("m"), scalar.placeholders(F.col("t")).alias("p")).collect()
    assert got[0].m == {"name": "a b", "kind": "c"} and got[0].p == ["who", "x.y"] and got[1].m == {} and got[1].p == []


def test_perfect_and_gated_pairs(spark):
    rows = [(c, n, c) for c in range(4) for n in ("a", "b")] + [(9, "a", 9), (9, "c", 9)] + [(50, f"n{i}", 50) for i in range(300)]
    p = pairs.cochange(spark.createDataFrame(rows, "c int, n string, t int"), "c", "n", "t")
    got = {(r.left, r.right): r for r in p.collect()}
    assert set(got) == {("a", "b"), ("a", "c")}  # the basket of 300 is left out
    r = got["a", "b"]
    assert (r.support, r.left_n, r.right_n, r.left_conditional, r.right_conditional, r.jaccard, r.last_at) == (4, 5, 4, 0.8, 1.0, 0.8, 3)
    assert [(x.left, x.right) for x in pairs.strong(p).collect()] == [("a", "b")]


def test_static_relation(spark):
    p = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("x", "y")], "left string, right string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    reach = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "c")], "src string, dst string")
    got = {(r.left, r.right): r.static_relation for r in pairs.static_relation(p, edges, reach).collect()}
    assert got == {("a", "b"): "both", ("a", "c"): "indirect", ("b", "c"): "left-to-right", ("x", "y"): "none"}


def test_cost_tiers(spark):
    tiers = F.from_json(F.lit('[{"min_tokens":0,"max_tokens":100,"rate":1},{"min_tokens":100,"max_tokens":null,"rate":2}]'), "array<struct<min_tokens:double,max_tokens:double,rate:double>>")
    df = spark.createDataFrame([(50.0,), (100.0,), (None,)], "n double")
    got = [r.x for r in df.select(metering.tier_rate(tiers, F.col("n"), F.lit(9.0)).alias("x")).collect()]
    assert got == [1.0, 2.0, 9.0]


def test_all_or_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None)], "k string, c double")
    assert {r.k: r.x for r in df.groupBy("k").agg(stats.all_or_nothing_sum(F.col("c")).alias("x")).collect()} == {"a": 3.0, "b": None}


def test_recovered_and_paging(spark):
    base = spark.createDataFrame([(1, False, "a"), (2, True, "b")], "k int, lost boolean, v string")
    found = spark.createDataFrame([(1, False, "x"), (2, False, "y"), (3, False, "z")], "k int, lost boolean, v string")
    assert sorted((r.k, r.v) for r in sets.recovered(base, found, "k", "lost").collect()) == [(1, "a"), (2, "y"), (3, "z")]
    rows, following, total = sets.page(spark.range(5), ["id"], 2, 2)
    assert ([r.id for r in rows.collect()], following, total) == ([2, 3], 4, 5)
    with pytest.raises(ValueError):
        sets.page(spark.range(5), ["id"], 0, 0)


def test_maximal_sequences(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["b", "c"],), (["c", "d"],), (["b"],)], "p array<string>")
    assert sorted(tuple(r.p) for r in sets.maximal_sequences(df, "p").collect()) == [("a", "b", "c"), ("c", "d")]


def test_violations_and_relabel(spark):
    r = spark.createDataFrame([("r1", "a/b", True), ("r2", "a", False)], "rule string, facet string, required boolean")
    f = spark.createDataFrame([(1, "a/b/c"), (2, "a/x")], "id int, place string")
    assert [(x.rule, x.id) for x in rules.violations(r, f).collect()] == [("r1", 1)]
    d = spark.createDataFrame([(["x"], ["x"]), (["x"], ["x", "y"]), (["x"], [])], "home array<string>, away array<string>")
    assert [x.label for x in rules.relabelled(d, "home", "away").collect()] == ["shares-domain", "crosses-domain", "crosses-domain"]


def test_weighted_share_and_zero_fill(spark):
    df = spark.createDataFrame([(0.5, None), (1.0, 0.0), (None, None)], "a double, b double")
    assert [r.x for r in df.select(rollup.weighted_share({"a": 1.0, "b": 3.0}).alias("x")).collect()] == [0.5, 0.25, 0.0]
    known = spark.createDataFrame([("p",), ("q",)], "k string")
    got = metering.with_known_ids(spark.createDataFrame([("p", 3)], "k string, n int"), known, "k", ["n"])
    assert sorted((r.k, r.n) for r in got.collect()) == [("p", 3), ("q", 0)]
