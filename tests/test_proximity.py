"""Folders and regions that disagree, against a plain model."""

import random
from collections import Counter, defaultdict

from gneiss.operators import proximity


def test_close_and_apart(spark):
    rng = random.Random(4)
    modules, regions, links, region_of = [], [], set(), {}
    for p in ("p", "q"):
        root = "" if p == "p" else "packages/q"
        for i in range(40):
            folder = rng.choice([".", "src", "src/a", "src/b/c"])
            name = f"m{i}.ts" if folder == "." else f"{folder}/m{i}.ts"
            modules.append((p, root, name, folder))
            if rng.random() < 0.85:
                region_of[p, name] = f"{p}-r{rng.randrange(9)}"
                regions.append((p, name, region_of[p, name]))
            else:
                regions.append((p, name, None))
        links |= {(p, f"{p}-r{rng.randrange(9)}", f"{p}-r{rng.randrange(9)}") for _ in range(3)}
    full = {(p, n): n if not root else f"{root}/{n}" for p, root, n, _ in modules}
    place = {(p, n): (f if not root else root if f == "." else f"{root}/{f}") for p, root, n, f in modules}
    pairs = [(full[a], full[b]) for a, b in (rng.sample(list(full), 2) for _ in range(5))]
    name = {v: k for k, v in full.items()}
    near = {(p, min(a, b), max(a, b)) for p, a, b in links if a != b}
    for left, right in pairs:
        x, y = region_of.get(name[left]), region_of.get(name[right])
        if x and y and x != y and name[left][0] == name[right][0]:
            near.add((name[left][0], min(x, y), max(x, y)))
    counts = defaultdict(Counter)
    for m, r in region_of.items():
        counts[m[0], r][place[m]] += 1
    home = {k: min(c, key=lambda f: (-c[f], f)) for k, c in counts.items()}
    apart = {full[m] for m, r in region_of.items() if home[m[0], r] != place[m]}
    want = set()
    for p, folder in {(m[0], place[m]) for m in full}:
        inside = {r for m, r in region_of.items() if m[0] == p and place[m] == folder}
        groups = [{r} for r in inside]
        for q, a, b in near:
            if q == p and a in inside and b in inside:
                x, y = (next(g for g in groups if r in g) for r in (a, b))
                if x is not y:
                    groups.remove(y)
                    x |= y
        for g in groups if len(groups) > 1 else []:
            files = [full[m] for m, r in region_of.items() if m[0] == p and place[m] == folder and r in g]
            want.add((p, folder, min(g), len(g), len(files), len(apart & set(files)), sum(1 for m in full if m[0] == p and place[m] == folder and m not in region_of)))
    files = proximity.placed(spark.createDataFrame(modules, "package string, root string, module string, folder string").selectExpr("*", "1 as region", "2 as home"), spark.createDataFrame(regions, "package string, module string, region string"))
    got = proximity.related(files, spark.createDataFrame(list(links), "package string, from string, to string"), spark.createDataFrame(pairs, "left string, right string"))
    assert {tuple(r) for r in got.collect()} == near
    assert {tuple(r) for r in proximity.close_folders(files, got).select("package", "folder", "first_region", "regions", "files", "apart", "unresolved").collect()} == want
    far = {r.file: r.distance for r in proximity.files_apart(files).collect()}
    assert set(far) == apart and all(d > 0 for d in far.values())
    assert proximity.close_folders(files, got.limit(0)).count() >= len(want)
