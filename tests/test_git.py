"""History scans in git's formats, over splits of any size."""

import pytest

from gneiss.sources import git

N = "\0"
LOG = (
    "\x01h3\x002024-03-01T00:00:00Z\x00Ann B\x00\n3\t1\tsrc/a b.ts\x00-\t-\tlogo.png\x000\t0\t\x00old => name.ts\x00src/new\tname.ts\x007\t0\tafter.ts\x00\x00"
    "\x01h2\x002024-02-01T00:00:00Z\x00\x00"
    "\x01broken\x00"
    "\x01h1\x002024-01-01T00:00:00Z\x00Cy\nD\x00\n1\t0\tline\nend.ts\x001\t2\t\x00a/x.ts\x00b/{x => y}.ts\x00"
)


@pytest.mark.parametrize("split", [None, 16])
def test_log(spark, tmp_path, split):
    (tmp_path / "log").write_bytes(LOG.encode())
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        if split:
            spark.conf.set(key, split)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
        log = git.commits(spark, str(tmp_path / "log"))
        assert not split or log.rdd.getNumPartitions() > 4
        assert [(r.hash, r.author, len(r.entries)) for r in log.orderBy("place").collect()] == [("h3", "Ann B", 4), ("h2", "", 0), ("h1", "Cy\nD", 2)]
        got = {(r.hash, r.path, r.previous_path, r.additions, r.deletions) for r in git.changes(log).collect()}
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {
        ("h3", "src/a b.ts", None, 3, 1), ("h3", "logo.png", None, None, None), ("h3", "src/new\tname.ts", "old => name.ts", 0, 0), ("h3", "after.ts", None, 7, 0),
        ("h1", "line\nend.ts", None, 1, 0), ("h1", "b/{x => y}.ts", "a/x.ts", 1, 2),
    }


def test_names_that_look_like_counts(spark, tmp_path):
    (tmp_path / "log").write_bytes(b"\x01h\x00t\x00me\x00\n1\t1\t\x002\t2\tx\x003\t3\ty\x004\t4\tz\x00")
    got = [(r.path, r.previous_path, r.additions) for r in git.changes(git.commits(spark, str(tmp_path / "log"))).orderBy("additions").collect()]
    assert got == [("3\t3\ty", "2\t2\tx", 1), ("z", None, 4)]


def test_tracked_files_and_empty_logs(spark, tmp_path):
    (tmp_path / "ls").write_bytes(b"a.ts\0dir/b c.ts\0line\nend\0")
    assert sorted(r.path for r in git.tracked_files(spark, str(tmp_path / "ls")).collect()) == ["a.ts", "dir/b c.ts", "line\nend"]
    (tmp_path / "none").write_bytes(b"")
    log = git.commits(spark, str(tmp_path / "none"))
    assert log.count() == 0 and git.changes(log).count() == 0


def test_timeline(spark, tmp_path):
    numstat = (
        "\x01c3\x00t3\x00c2 side\x00\n0\t9\tsrc/a.ts\x002\t1\t\x00src/b.ts\x00src/c.ts\x00-\t-\timg.png\x00"
        "\x01c2\x00t2\x00c1\x00\n4\t0\tsrc/a.ts\x001\t0\treadme.md\x00"
        "\x01c1\x00t1\x00c0\x00\n5\t0\tsrc/b.ts\x000\t3\tsrc/gone.ts\x00"
    )
    status = "\x01c3\x00\nD\x00src/a.ts\x00R090\x00src/b.ts\x00src/c.ts\x00M\x00img.png\x00\x01c2\x00\nA\x00src/a.ts\x00A\x00readme.md\x00\x01c1\x00\nA\x00src/b.ts\x00D\x00src/gone.ts\x00"
    (tmp_path / "n").write_bytes(numstat.encode())
    (tmp_path / "s").write_bytes(status.encode())
    log = git.timeline(spark, str(tmp_path / "n"), str(tmp_path / "s"), r"\.ts$")
    rows = [(r.hash, list(r.parents), r.additions, r.deletions, r.changed_files, [tuple(x) for x in r.renamed], list(r.added), list(r.removed)) for r in log.orderBy("place", ascending=False).collect()]
    assert rows == [
        ("c1", ["c0"], 5, 3, 2, [], ["src/b.ts"], ["src/gone.ts"]),
        ("c2", ["c1"], 5, 0, 2, [], ["src/a.ts"], []),
        ("c3", ["c2", "side"], 2, 10, 3, [("src/b.ts", "src/c.ts")], [], ["src/a.ts"]),
    ]
    assert git.seed_commit(log) == "c0"
    seed = spark.createDataFrame([("src/gone.ts",), ("src/stays.ts",)], "path string")
    spans = {(r.path, r.since, r.until) for r in git.lifespans(log, seed).collect()}
    assert spans == {("src/gone.ts", None, "c1"), ("src/stays.ts", None, None), ("src/b.ts", "c1", "c3"), ("src/a.ts", "c2", "c3"), ("src/c.ts", "c3", None)}
