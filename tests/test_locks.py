"""Dependency graphs of manifests and lock files, case by case."""

import json

from gneiss.operators import locks

LOCK = """{ // a text lock
  "lockfileVersion": 1,
  "workspaces": {
    "": {"name": "top", "devDependencies": {"x": "^1"},},
    "packages/a": {"name": "a", "dependencies": {"x": "^2", "a//b": "1,}", "@s/y": "1", "b": "workspace:*"}, "peerDependencies": {"p": "1", "q": "1"}},
    "packages/b": {"name": "b"}, "packages/c": {"name": "other"},
  }, /* entries */
  "packages": {
    "x": ["x@1.0.0", "", {"dependencies": {"z": "1"}}, "sha"],
    "a/x": ["x@2.0.0", "", {"dependencies": {"@s/y": "2", "z": "1"}, "optionalDependencies": {"gone": "1"}}],
    "a/x/@s/y": ["@s/y@2.0.0", "", {"dependencies": {"z": "3"}}],
    "a/x/z": ["z@9.0.0", "", {}],
    "@s/y": ["@s/y@1.0.0", "", {"peerDependencies": {"p": "1"}, "peerDependenciesMeta": {"p": {"optional": true}}}],
    "a//b": ["a//b@1", "", {}],
    "z": ["z@1.0.0", ""],
    "a": ["a@workspace:packages/a"], "b": ["b@workspace:packages/b"], "wrong": ["wrong@workspace:packages/c"], "absent": ["n@workspace:packages/none"],
    "bad": {"x": 1}, "bad2": [7], "bare": ["@scope"],
  },
}"""


def rows(spark):
    a = {"name": "a", "version": "1.1", "dependencies": {"x": "^2", "a//b": "1,}", "@s/y": "1", "b": "workspace:*", "n": 3}, "peerDependencies": {"p": "1", "q": "1"}, "peerDependenciesMeta": {"p": {"optional": True}, "q": {"optional": "yes"}}}
    top = {"name": "top", "devDependencies": {"x": "^1", "new": "1"}}
    c = {"name": "c", "dependencies": {"b": "workspace:*", "x": "1"}}
    manifests = [("r", "", "root", json.dumps(top)), ("r", "packages/a", "workspace", json.dumps(a)), ("r", "packages/b", "workspace", '{"name": "b"}'), ("r", "packages/c", "workspace", json.dumps(c)), ("r", "packages/d", "workspace", "[1]"), ("r", "packages/e", "workspace", None)]
    manifests += [("home/nolock", "", "root", '{"dependencies": {"x": "1"}}'), ("old", "", "root", '{"name": "o"}'), ("torn", "", "root", '{"name": "t"}')]
    return spark.createDataFrame(manifests, "root string, path string, role string, manifest string"), spark.createDataFrame([("r", LOCK), ("old", '{"lockfileVersion": 0, "packages": {}, "workspaces": {}}'), ("torn", '{"lockfileVersion": 1, "pack'), ("home/nolock", None)], "root string, lock string")


def test_graph_and_issues(spark):
    nodes, edges, issues = locks.dependency_graph(*rows(spark))
    got = {(r.root, r.source, r.kind, r.name): (r.target, r.optional) for r in edges.collect()}
    assert got == {
        ("r", "workspace-root:", "devDependencies", "x"): ("lock:x", False),
        ("r", "workspace-root:", "devDependencies", "new"): (None, False),
        ("r", "a", "dependencies", "x"): ("lock:a/x", False),
        ("r", "a", "dependencies", "a//b"): ("lock:a//b", False),
        ("r", "a", "dependencies", "@s/y"): ("lock:@s/y", False),
        ("r", "a", "dependencies", "b"): ("b", False),
        ("r", "a", "peerDependencies", "p"): (None, True),
        ("r", "a", "peerDependencies", "q"): (None, False),
        ("r", "c", "dependencies", "b"): ("b", False),  # by its range, though the manifest differs
        ("r", "c", "dependencies", "x"): (None, False),
        ("r", "lock:x", "dependencies", "z"): ("lock:z", False),
        ("r", "lock:a/x", "dependencies", "@s/y"): ("lock:a/x/@s/y", False),
        ("r", "lock:a/x", "dependencies", "z"): ("lock:a/x/z", False),
        ("r", "lock:a/x", "optionalDependencies", "gone"): (None, True),
        ("r", "lock:a/x/@s/y", "dependencies", "z"): ("lock:a/x/z", False),
        ("r", "lock:@s/y", "peerDependencies", "p"): (None, True),
        ("home/nolock", "workspace-root:", "dependencies", "x"): (None, False),
    }
    assert {(r.root, r.issue, r.subject) for r in issues.collect()} == {
        ("r", "unreadable-manifest", "packages/d"), ("r", "unreadable-manifest", "packages/e"), ("r", "unreadable-entry", "bad"), ("r", "unreadable-entry", "bad2"), ("r", "unsupported-descriptor", "bare"),
        ("r", "workspace-identity", "packages/c"), ("r", "missing-metadata", "z"), ("r", "manifest-identity", "packages/c"), ("r", "manifest-differs", "c dependencies.b"), ("r", "manifest-differs", "c dependencies.x"),
        ("r", "manifest-differs", "top devDependencies.new"), ("r", "unresolved", "6"), ("home/nolock", "no-lock", ""), ("home/nolock", "unresolved", "1"), ("old", "unsupported-lock", ""), ("torn", "unsupported-lock", ""),
    }
    got = {(r.root, r.id): (r.kind, r.name, r.version) for r in nodes.collect()}
    assert got[("r", "a")] == ("workspace", "a", "1.1") and got[("r", "lock:a/x/@s/y")] == ("external", "@s/y", "2.0.0") and got[("home/nolock", "workspace-root:")] == ("workspace", "nolock", None)
    assert len(got) == 4 + 7 + 3


def test_empty_tables(spark):
    manifests, lock = rows(spark)
    for nodes, edges, issues in (locks.dependency_graph(manifests.limit(0), lock.limit(0)), locks.dependency_graph(manifests.limit(0), lock)):
        assert nodes.filter("kind = 'workspace'").count() == 0 and edges.filter("source not like 'lock:%'").count() == 0
        assert issues.filter("issue = 'no-lock'").count() == 0
