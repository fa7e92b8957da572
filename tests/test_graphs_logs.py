"""Graph measures against naive models, logs in batch and streaming form, sources and sinks."""

import datetime as dt
import json
import os
import random
import time
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from gneiss.operators import paths as paths_
from gneiss.operators import backlog, graph, history, kernels, log, metering, rollup, structure, text
from gneiss.sources import readers, writers
from gneiss.streaming import changes


def random_graph(spark, seed, n=12, m=20):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    adjacency = defaultdict(set)
    for a, b in edges:
        if a != b:
            adjacency[a].add(b)
    return spark.createDataFrame([(i,) for i in range(n)], "id int"), spark.createDataFrame(edges, "src int, dst int"), adjacency, n


def distances(adjacency, s):
    dist, queue = {s: 0}, deque([s])
    while queue:
        v = queue.popleft()
        for w in adjacency[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                queue.append(w)
    return dist


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_components_layers(spark, seed):
    nodes, edges, adjacency, n = random_graph(spark, seed)
    want = {(s, t): d for s in range(n) for t, d in distances(adjacency, s).items() if t != s}
    got = {(r.src, r.dst): r.hops for r in graph.closure(edges, distance=True).collect()}
    assert got == want
    reach = graph.closure(edges)
    scc = {r.id: (r.component, r.size) for r in graph.strong_components(nodes, edges).collect()}
    member = {i: {j for j in range(n) if j == i or ((i, j) in want and (j, i) in want)} for i in range(n)}
    assert scc == {i: (min(m), len(m)) for i, m in member.items()}
    down = {(min(member[a]), min(member[b])) for a in adjacency for b in adjacency[a]}
    down = {(a, b) for a, b in down if a != b}

    def depth(c):
        return max((depth(b) + 1 for a, b in down if a == c), default=0)

    layers = {r.id: r.layer for r in graph.layers(graph.strong_components(nodes, edges), edges).collect()}
    assert layers == {i: depth(min(member[i])) for i in range(n)}
    both = defaultdict(set)
    for a in adjacency:
        for b in adjacency[a]:
            both[a].add(b)
            both[b].add(a)
    weak = {r.id: r.component for r in graph.weak_components(nodes, edges).collect()}
    assert weak == {i: min(distances(both, i)) for i in range(n)}


@pytest.mark.parametrize("seed", [3, 4])
def test_betweenness_and_articulation(spark, seed):
    nodes, edges, adjacency, n = random_graph(spark, seed)
    total = defaultdict(float)

    def paths(s, t, dist):
        return [[s]] if s == t else [p + [t] for v in range(n) if t in adjacency[v] and dist.get(v, 99) + 1 == dist[t] for p in paths(s, v, dist)]

    for s in range(n):
        dist = distances(adjacency, s)
        for t in dist:
            if t != s:
                every = paths(s, t, dist)
                for p in every:
                    for v in p[1:-1]:
                        total[v] += 1 / len(every)
    got = {r.id: r.betweenness for r in paths_.betweenness(nodes, edges)[0].collect()}
    assert all(abs(got[i] - total[i] / ((n - 1) * (n - 2))) < 1e-9 for i in range(n))
    both = defaultdict(set)
    for a in adjacency:
        for b in adjacency[a]:
            both[a].add(b)
            both[b].add(a)
    linked = set(both)

    def count(without):
        left, c = linked - {without}, 0
        while left:
            c += 1
            seen = set(distances(defaultdict(set, {k: v - {without} for k, v in both.items()}), next(iter(left))))
            left -= seen
        return c

    cut = {r.id for r in paths_.articulation_points(nodes, edges).collect()}
    assert cut == {i for i in linked if count(i) > count(None)}


def test_modularity_merges_components_apart(spark):
    """A package of 3,000 rings of four has 12,000 ties: looked through whole at each merge they took hours."""
    began = time.time()
    ring = F.expr("explode(transform(array(array(0, 1), array(1, 2), array(2, 3), array(0, 3)), x -> struct(4 * id + x[0] as src, 4 * id + x[1] as dst)))")
    e = spark.range(3000).select(F.lit("p").alias("p"), ring.alias("e")).select("p", "e.*", F.lit(1.0).alias("weight"))
    groups = defaultdict(set)
    for r in kernels.modularity_groups(e, "p").collect():
        groups[r.group].add(r.id)
    assert groups == {4 * i: {4 * i, 4 * i + 1, 4 * i + 2, 4 * i + 3} for i in range(3000)}
    assert time.time() - began < 150


def test_modularity_equals_exhaustive_merges(spark):
    rng = random.Random(9)
    for _ in range(3):
        e = [("p", a, b, float(rng.randint(1, 5))) for a in range(7) for b in range(a + 1, 7) if rng.random() < 0.5]
        got = {r.id: r.group for r in kernels.modularity_groups(spark.createDataFrame(e, "p string, src int, dst int, weight double"), "p").collect()}
        nodes = sorted({x for _, a, b, _ in e for x in (a, b)})
        total = sum(w for *_, w in e)

        def quality(groups):
            inside = sum(w for _, a, b, w in e if groups[a] == groups[b]) / total
            spread = sum((sum(w * ((groups[a] == g) + (groups[b] == g)) for _, a, b, w in e) / (2 * total)) ** 2 for g in set(groups.values()))
            return inside - spread

        groups = {n: n for n in nodes}
        while True:  # every join of two groups is tried, whole quality compared
            now, best = quality(groups), None
            for a in sorted(set(groups.values())):
                for b in sorted(set(groups.values())):
                    if a < b:
                        gain = quality({n: a if g == b else g for n, g in groups.items()}) - now
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, a, b)
            if best is None:
                break
            groups = {n: best[1] if g == best[2] else g for n, g in groups.items()}
        assert got == groups


def test_corridors_are_maximal_and_capped_pairs_reported(spark):
    line = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    got, capped = paths_.corridors(line)
    assert {(r.corridor, r.length, r.support) for r in got.collect()} == {("a→b→c→d", 3, 2), ("b→c→d→e", 3, 2)} and capped.count() == 0
    wide = [(0, i) for i in range(1, 34)] + [(i, 100) for i in range(1, 34)] + [(100, 101)]
    got, capped = paths_.corridors(spark.createDataFrame(wide, "src int, dst int"))
    assert {tuple(r) for r in capped.collect()} == {(0, 100), (0, 101)}
    assert got.count() == 0  # each i -> 100 -> 101 is on one pair's paths only


def test_cut_edges_and_chains(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("c", "x"), ("q", "a")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcxyzqr"], "id string")
    rows = {(r.src, r.dst): (r.routes, r.severed, r.bridge, r.src_side, r.dst_side) for r in paths_.edge_structure(nodes, edges).collect()}
    assert rows["c", "x"] == (0, 11, True, 4, 3) and rows["q", "a"] == (0, 5, True, 1, 6) and rows["a", "b"][0] == 0 and not rows["a", "b"][2]
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert [r.bridge for r in paths_.edge_structure(nodes, ring).collect()] == [False, False]  # the other direction holds them together
    parts = graph.strong_components(nodes, edges)
    assert [tuple(r) for r in paths_.longest_chains(parts, edges).collect()] == [("q→[a|b|c]→[x|y|z]", 3)]


def test_availability_and_parents(spark):
    # 1 waits for 8; 4 and 5 lie below the open 2; 7 is its own parent; 9 and 10 are each other's, 10 is active; 11 lies below a settled task.
    rows = [(1, "open", None), (2, "open", None), (3, "done", None), (4, "open", 2), (5, "open", 4), (6, "active", None), (7, "open", 7), (8, "open", None), (9, "open", 10), (10, "active", 9), (11, "open", 3), (12, "open", 99)]
    tasks = spark.createDataFrame(rows, "id int, status string, parent_id int")
    deps = spark.createDataFrame([(1, 8), (1, 3), (1, 99), (2, 6)], "task_id int, depends_on_id int")
    got = {r.id: (r.availability, r.blocked_by, r.waiting_on) for r in backlog.availability(tasks, deps, ["done"], ["active"], parent_gate=True).collect()}
    assert got == {
        1: ("blocked", [8], []), 2: ("blocked", [6], []), 3: ("settled", [], []), 4: ("blocked", [], [2]), 5: ("blocked", [], [2, 4]), 6: ("active", [], []), 7: ("ready", [], []), 8: ("ready", [], []),
        9: ("ready", [], []), 10: ("active", [], []), 11: ("ready", [], []), 12: ("ready", [], []),
    }
    assert sorted(r.id for r in backlog.ready(tasks, deps, ["done"]).collect()) == [7, 8, 9, 11, 12]
    assert sorted(r.id for r in backlog.ready(tasks, deps, ["done"], parent_gate=False).collect()) == [4, 5, 7, 8, 9, 11, 12]
    # Both forms agree on parent cycles and deep chains.
    rng = random.Random(5)
    rows = [(i, rng.choice(["open", "active", "done"]), rng.choice([None, rng.randrange(60), i])) for i in range(60)] + [(i, "active", i - 1 if i > 100 else 0) for i in range(100, 260)]
    tasks = spark.createDataFrame(rows, "id int, status string, parent_id int")
    below = {r.id for r in backlog.below_open(tasks).collect()}
    assert below == {r.id for r in backlog.open_ancestors(tasks).collect()}


def test_renames_follow_chains(spark):
    got = {(r.old, r.final) for r in history.rename_finals(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "old string, new string")).collect()}
    assert got == {("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")}
    deep = [(i, i + 1) for i in range(1500)] + [(2000, 2001), (2001, 2000), (1999, 2000)]
    got = {r.old: r.final for r in history.rename_finals(spark.createDataFrame(deep, "old int, new int")).collect()}
    assert got == dict.fromkeys(range(1500), 1500)


def test_windowed_churn_keeps_full_history(spark):
    rows = [("c1", "f", "ann", 1, 5, 1), ("c2", "f", "bob", 10, 7, None), ("c3", "g", "ann", 2, 1, 0)]
    df = spark.createDataFrame(rows, "e string, p string, a string, t int, plus int, minus int")
    h = history.History("e", "p", "a", "t", "plus", "minus")
    got = {r.p: r for r in history.churn(df, h, F.lit(5)).collect()}
    assert (got["f"].commits, got["f"].additions, got["f"].primary_author, got["f"].first_changed_at, got["f"].last_changed_at) == (1, 7, "bob", 1, 10)
    assert (got["g"].commits, got["g"].authors, got["g"].primary_author, got["g"].primary_share) == (0, 0, None, 0.0)


@pytest.mark.parametrize("seed", range(3))
def test_blocks_against_removal(spark, seed):
    """Tree edges share a block where no single node parts them; cut nodes and edges are those whose removal parts a component."""
    from gneiss.operators import blocks

    rng = random.Random(seed)
    n = 26
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(30)] + [(30, 31), (31, 32), (32, 30), (32, 33), (33, 34), (34, 35), (35, 33), (40, 41)]
    names = [*range(n), *range(30, 36), 40, 41, 50]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def parts(gone=(), lost=None):
        seen = {}
        for s in names:
            if s in gone or s in seen:
                continue
            seen[s], queue = s, [s]
            for v in queue:
                for w in near[v]:
                    if w not in gone and w not in seen and {v, w} != lost:
                        seen[w] = s
                        queue.append(w)
        return seen

    whole = parts()
    table = blocks.blocks(spark.createDataFrame([(i,) for i in names], "id int"), spark.createDataFrame(edges, "src int, dst int"))
    rows = {r.node: r for r in table.collect()}
    assert sorted(rows) == sorted(names)
    want = {x for x in names if len(set(parts((x,)).values())) > len(set(whole.values())) - (not near[x])}
    assert {r.id for r in blocks.cut_nodes(table).collect()} == want
    alone = {frozenset((r.node, r.up)) for r in blocks.cut_edges(table).collect()}
    assert alone == {frozenset((a, b)) for a in near for b in near[a] if parts(lost={a, b})[a] != parts(lost={a, b})[b]}
    for v, r in rows.items():
        for w, q in rows.items():
            if r.up is not None and q.up is not None and v != w:
                # One block: no node outside both edges' shared ends separates them.
                together = whole[v] == whole[w] and all(parts((x,)).get(next(iter({v, r.up} - {x}))) == parts((x,)).get(next(iter({w, q.up} - {x}))) for x in names)
                assert (r.block == q.block) == together


def test_hubs_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(graph.Hubs, "LEAST", 3)
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 40)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(20)]
    nodes, frame = spark.createDataFrame([(i,) for i in range(60)], "id int"), spark.createDataFrame(edges, "src int, dst int")
    with_hubs = sorted(map(tuple, graph.weak_components(nodes, frame).collect()))
    monkeypatch.setattr(graph.Hubs, "LEAST", 1000)
    assert with_hubs == sorted(map(tuple, graph.weak_components(nodes, frame).collect()))


def test_author_ties_go_to_the_newest_event(spark):
    h = history.History("e", "p", "a", "t", "plus")
    rows = [("c1", "f", "ann", 1, 1), ("c2", "f", "zoe", 9, 1), ("c3", "f", "ann", 2, 1), ("c4", "f", "zoe", 3, 1), ("c5", "g", "zoe", 9, 1), ("c6", "g", "ann", 9, 1), ("c7", "h", "ann", 9, 1), ("c8", "h", "zoe", 5, 1), ("c9", "h", "zoe", 6, 1)]
    got = {r.p: r.primary_author for r in history.churn(spark.createDataFrame(rows, "e string, p string, a string, t int, plus int"), h).collect()}
    assert got == {"f": "zoe", "g": "zoe", "h": "zoe"}


def test_limits_and_budgets(spark):
    schema = "id string, o int, kind string, used_percent double, cap double, used double, remaining double, resets_at timestamp, starts_at timestamp"
    at = [dt.datetime(2025, 1, d) for d in range(1, 6)]
    rows = [
        ("a", 1, "spend-cap", None, 100.0, 25.0, None, at[4], at[0]), ("b", 1, "window", 130.0, None, None, None, at[1], None), ("c", 1, "balance", None, None, None, -3.0, None, None),
        ("d", 1, "credit-balance", None, None, None, 7.0, None, None), ("e", 1, "spend-cap", None, 0.0, 0.0, None, None, None), ("f", 1, "spend-cap", None, 10.0, -5.0, None, None, None),
        ("g", 1, "spend-cap", None, 10.0, 5.0, None, at[2], None), ("h", 1, "spend-cap", None, 10.0, 5.0, None, None, at[3]), ("i", 1, "spend-cap", None, float("nan"), 5.0, None, None, None),
        ("i", 2, "spend-cap", None, 10.0, 5.0, None, None, None), ("j", 1, "spend-cap", None, -1.0, 5.0, None, None, None),
    ]
    df, now = spark.createDataFrame(rows, schema), F.lit(at[2])
    got = {(r.id, r.o): (r.headroom, r.share, r.unit, r.exhausted, r.resets_in_ms) for r in metering.headroom(df, now).collect()}
    assert got["a", 1] == (75.0, 0.75, "usd", False, 2 * 86_400_000) and got["b", 1] == (0.0, 0.0, "percent", True, 0)
    assert got["c", 1] == (0.0, None, "usd", True, None) and got["d", 1] == (7.0, None, "credits", False, None) and got["e", 1][:2] == (0.0, 0.0)
    budgets = {r.id: (r.cap, r.spent, r.remaining, r.share) for r in metering.valid_budgets(df, "id", "o", now).collect()}
    assert budgets == {"a": (100.0, 25.0, 75.0, 0.75), "e": (0.0, 0.0, 0.0, 0.0), "f": (10.0, -5.0, 15.0, 1.0)}


def test_operating_stats_and_next_due(spark):
    rows = [("complete", None, 0, 5, 9), ("failed", False, 0, 1, 4), ("queued", None, 3, None, None), ("cancelled", None, 9, 4, None), ("running", True, 0, 2, None), ("suspended", None, 0, None, None), ("odd", None, 0, None, None)]
    got = rollup.operating_stats(spark.createDataFrame([("k", *r) for r in rows], "k string, status string, attention boolean, created_at long, started_at long, ended_at long"), ["k"]).first()
    assert (got.complete, got.failed, got.queued, got.cancelled, got.running, got.waiting, got.total) == (1, 1, 1, 1, 0, 2, 7)
    assert (got.success_rate, got.median_run_ms, got.median_queue_ms) == (0.5, 3.5, 1.5)
    due = spark.createDataFrame([("k", "waiting", None, 1), ("k", "waiting", 5, 2), ("l", "waiting", None, 4), ("l", "waiting", None, 3), ("l", "done", 1, 9)], "k string, s string, due int, id int")
    assert sorted((r.k, r.due, r.id) for r in structure.next_due(due, "k", "s", "due").collect()) == [("k", 5, 2), ("l", None, 3)]


def test_missed_ranges_and_runtime_metadata(spark):
    moves = spark.createDataFrame([("a", 0, 5, False), ("b", 0, 5, True), ("c", 3, 20, False), ("d", 10, 12, False), ("e", 4, 5, True)], "name string, `from` long, `to` long, handed boolean")
    assert sorted(map(tuple, log.missed_ranges(moves, 10).collect())) == [("a", 1, 5), ("b", 1, 4), ("c", 4, 10)]
    states = [("r", 1, "running", {"stream": "1"}), ("r", 2, "running", {"stream": "2", "workflow": "x"}), ("r", 3, "running", {"note": "n", "stream": "2"}), ("r", 4, "running", {"stream": "9", "note": "n"}), ("r", 5, "running", None)]
    got = log.change_events(spark.createDataFrame(states, "k string, o int, s string, m map<string,string>"), "k", "o", "s", ["m"], metadata="m")
    assert sorted((r.o, r.event) for r in got.collect()) == [(1, "queued"), (3, "updated"), (5, "updated")]


def test_history_log_and_inventory(spark, tmp_path):
    raw = "\x1eh1\x1f100\x1fann\n3\t1\tsrc/a.ts\n-\t-\timg.png\n\x1eh2\x1f200\x1fbob\n2\t0\tsrc/a.ts => src/b.ts\n"
    (tmp_path / "log").write_text(raw)
    got = sorted((r.hash, r.path, r.previous_path, r.additions, r.author) for r in readers.history_log(spark, str(tmp_path / "log")).collect())
    assert got == [("h1", "img.png", None, None, "ann"), ("h1", "src/a.ts", None, 3, "ann"), ("h2", "src/b.ts", "src/a.ts", 2, "bob")]
    tree = tmp_path / "tree"
    for p in ("one/package.json", "one/src/a.ts", "two/package.json", "skip/x.ts"):
        os.makedirs((tree / p).parent, exist_ok=True)
        (tree / p).write_text('{"name": "n", "dependencies": {"d": "1"}}' if p.endswith("json") else "x")
    files = readers.file_inventory(spark, str(tree), [("^skip/", True)])
    assert sorted(r.path for r in files.collect()) == ["one/package.json", "one/src/a.ts", "two/package.json"]
    found = {r.folder: (r.kept, r.reason) for r in readers.workspaces(files, r"package\.json", r"\.ts$").collect()}
    assert found == {"one": (True, None), "two": (False, "no source files")}
    (tree / "two/package.json").write_text("{broken")
    deps, bad = readers.manifests(spark, str(tree / "*/package.json"), ["dependencies"])
    assert [(r.package, r.kind, r.name, r.range) for r in deps.collect()] == [("n", "dependencies", "d", "1")]
    assert bad.count() == 1


def test_transcripts_skip_malformed(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"usage": 1, "id": "a"}\n{"usage": \n{"id": "b"}\n{"usage": 3, "id": "c"}\n')
    got = readers.transcripts(spark, str(tmp_path), "usage int, id string", '"usage"').collect()
    assert [(r.id, r.usage) for r in got] == [("a", 1), ("c", 3)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([("p", 2, "x"), ("q", 1, "y"), ("p", 1, "z")], "package string, id int, v string")
    writers.write_shards(df, path)
    assert [r.id for r in readers.package_shards(spark, path, ["p"]).orderBy("id").collect()] == [1, 2]
    target = str(tmp_path / "live")
    writers.publish(df, target)
    change = spark.createDataFrame([("q", 1, "new", False), ("p", 2, "x", True), ("r", 9, "add", False)], "package string, id int, v string, gone boolean")
    writers.upsert(spark, target, change, ["package", "id"], "gone")
    assert sorted((r.package, r.id, r.v) for r in spark.read.parquet(target).collect()) == [("p", 1, "z"), ("q", 1, "new"), ("r", 9, "add")]
    assert os.listdir(tmp_path).count("live") == 1 and not [x for x in os.listdir(tmp_path) if "staging" in x]


RUNS = [("r", 1, "queued", 1, 1), ("r", 2, "running", 2, 2), ("r", 3, "running", 2, 3), ("r", 4, "complete", 2, 4), ("r", 5, None, None, None), ("r", 6, "queued", 1, 1), ("s", 1, "running", None, 1), ("s", 2, "running", None, 1), ("s", 3, "parked", 1, 1)]


def test_change_events_by_case(spark):
    df = spark.createDataFrame(RUNS, "k string, o int, s string, output int, t int")
    got = sorted(tuple(r) for r in log.change_events(df, "k", "o", "s", ["output", "t"], "t").collect())
    assert got == [
        ("r", 1, "queued", ""), ("r", 2, "started", ""), ("r", 2, "updated", "output"), ("r", 3, "updated", "t"), ("r", 4, "completed", ""), ("r", 5, "removed", ""), ("r", 6, "queued", ""),
        ("s", 1, "queued", ""), ("s", 3, "entered parked", ""), ("s", 3, "updated", "output"),
    ]


def test_streamed_changes_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(5), i, rng.choice(["queued", "running", "complete", None]), rng.choice([1, 2, None]), rng.randrange(3)) for i in range(90)]
    source, out = tmp_path / "in", []
    os.makedirs(source)
    for b in range(3):
        with open(source / f"{b}.json", "w") as f:
            f.writelines(json.dumps({"k": k, "o": o, "s": s, "a": a, "t": t}) + "\n" for k, o, s, a, t in rows[b * 30 : b * 30 + 30])
        os.utime(source / f"{b}.json", (1000 + b, 1000 + b))
    schema = "k int, o long, s string, a int, t int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = changes.deliver(changes.change_events(stream, "k", "o", "s", ["a", "t"], "t"), lambda df, _: out.extend(map(tuple, df.collect())), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    batch = log.change_events(spark.createDataFrame(rows, schema), "k", "o", "s", ["a", "t"], "t")
    assert sorted(out) == sorted((r.k, r.o, r.event, r.changed) for r in batch.collect())


def test_publish_keeps_the_old_table_when_a_rename_fails(spark, tmp_path, monkeypatch):
    from gneiss.sources import writers

    path = str(tmp_path / "t")
    writers.publish(spark.range(3).toDF("id"), path)
    real = writers._move
    for bad in (1, 2):
        calls = []

        def failing(fs, a, b, bad=bad, calls=calls):
            calls.append(1)
            if len(calls) == bad:
                raise OSError("no")
            real(fs, a, b)

        monkeypatch.setattr(writers, "_move", failing)
        with pytest.raises(OSError):
            writers.publish(spark.range(9).toDF("id"), path)
        assert spark.read.parquet(path).count() == 3 and len(os.listdir(tmp_path)) == 1
    monkeypatch.setattr(writers, "_move", real)
    writers.publish(spark.range(5).toDF("id"), path)
    assert spark.read.parquet(path).count() == 5 and len(os.listdir(tmp_path)) == 1
    root = str(tmp_path / "v")
    for n in (2, 4):
        writers.publish_version(spark.range(n).toDF("id"), root)
        assert writers.read_version(spark, root).count() == n


def test_event_time_windows(spark, tmp_path):
    rows = [{"ts": f"2024-01-01T00:0{m}:00", "k": "a", "v": 1.0} for m in (0, 1, 7)]
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/0.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("ts timestamp, k string, v double").json(str(tmp_path / "in"))
    query = changes.windowed_counts(stream, "ts", "k", "v", "5 minutes", "0 seconds").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.n, r.total) for r in spark.table("w").collect()) == [(1, 1.0), (2, 2.0)]


def test_chunks_cover_the_text(spark):
    df = spark.createDataFrame([(1, "ab\ncd\nefg"), (2, ""), (3, None)], "id int, t string")
    got = text.fixed_chunks(df, "id", "t", 4).orderBy("id", "chunk").collect()
    assert [(r.id, r.start, r.end, r.first_line, r.last_line, r.content) for r in got] == [(1, 0, 4, 1, 2, "ab\nc"), (1, 4, 8, 2, 3, "d\nef"), (1, 8, 9, 3, 3, "g")]
    assert [r.content for r in text.recursive_chunks(df.filter("id = 1"), "id", "t", 100).collect()] == ["ab\ncd\nefg"]


def test_grep_modes(spark):
    df = spark.createDataFrame([(1, "alpha\nbeta\nAlps"), (2, "gamma"), (3, None)], "id int, t string")
    assert [(r.id, r.line, r.content) for r in text.grep(df, "id", "t", "^al", ignore_case=True).orderBy("line").collect()] == [(1, 1, "alpha"), (1, 3, "Alps")]
    assert [r.id for r in text.grep(df, "id", "t", "mm", "files").collect()] == [2]
    assert [(r.id, r.matches) for r in text.grep(df, "id", "t", "a", "count").orderBy("id").collect()] == [(1, 2), (2, 1)]
    with pytest.raises(ValueError):
        text.grep(df, "id", "t", "a", "none")
