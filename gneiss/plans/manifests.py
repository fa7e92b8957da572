"""Manifests and lock files written from the parts table, read back as dependency graphs: parts as entries nested in one another."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import locks
from .tables import table

#: The digits of a part's place in its repository, base 7, are the path of its entry; one of the names has a scope.
NAME = "case when {0} = 3 then '@s/n3' else concat('n', {0}) end"
DEPTH = "case when j < 7 then 1 when j < 49 then 2 when j < 343 then 3 when j < 2401 then 4 when j < 16807 then 5 else 6 end"
TOP = '{"name": "top", "dependencies": {"n1": "1", "n2": "2"}}'
INNER = '{"name": "n0", "dependencies": {"n1": "1", "top": "workspace:*"}}'


def _texts(spark, d):
    p = table(spark, d, "part").select(F.expr("concat('r', p_partkey % 40)").alias("root"), F.expr("p_partkey div 40").alias("j"), "p_size")
    digit = NAME.format("cast(floor(j / pow(7, i)) % 7 as int)")
    path = F.expr(f"array_join(transform(sequence({DEPTH} - 1, 0, -1), i -> {digit}), '/')")
    name = F.expr(NAME.format("cast(j % 7 as int)"))
    other = F.expr(NAME.format("cast(floor(j / 3) % 7 as int)"))
    meta = F.format_string(', "", {"dependencies": {"n%d": "^%d"}, "optionalDependencies": {"%s": "1"}}', F.col("j") % 5, F.col("p_size"), other)
    sound = F.concat(F.lit('["'), name, F.lit("@"), F.col("p_size").cast("string"), F.lit('"'), F.when(F.col("j") % 17 == 16, "").otherwise(meta), F.lit("]"))
    raw = F.when(F.col("j") % 11 == 10, '{"x": 1}').when(F.col("j") % 13 == 12, '["plain"]').otherwise(sound)
    entry = F.concat(F.lit('"'), path, F.lit('": '), raw, F.lit(","))  # the last comma stays: lock files may have it
    saved = '{"lockfileVersion": 1, "workspaces": {"": {"name": "top", "dependencies": {"n1": "1"}}, "in": ' + INNER + '}, "packages": {'
    lock = p.groupBy("root").agg(F.concat(F.lit(saved), F.array_join(F.collect_list(entry), "\n"), F.lit("}}")).alias("lock"))
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("path"), F.lit(b).alias("role"), F.lit(c).alias("manifest")) for a, b, c in (("", "root", TOP), ("in", "workspace", INNER))]))
    return lock.select("root", both.alias("m")).select("root", "m.*"), lock


def lock_edges(spark, d):
    """Declarations of every package and lock entry with what they resolve to."""
    _, edges, _ = locks.dependency_graph(*_texts(spark, d))
    return edges.withColumn("target", F.coalesce("target", F.lit("-")))


def lock_issues(spark, d):
    """What the lock files' reader could not read or confirm."""
    return locks.dependency_graph(*_texts(spark, d))[2]


_ENTRIES = f"""with p as (select 'r' || (p_partkey % 40) as root, p_partkey // 40 as j, p_size from part),
q as (select *, array_to_string(list_transform(range({DEPTH} - 1, -1, -1), lambda i: {NAME.format("((j // (7 ** i)::bigint) % 7)")}), '/') as locator, {NAME.format("(j // 3 % 7)")} as other from p),
good as (select * from q where j % 11 <> 10 and j % 13 <> 12),
ask as (select root, 'lock:' || locator as source, locator, 'dependencies' as kind, 'n' || (j % 5) as name, '^' || p_size as range, false as optional, false as differs from good where j % 17 <> 16
  union all select root, 'lock:' || locator, locator, 'optionalDependencies', other, '1', true, false from good where j % 17 <> 16
  union all select distinct root, s, l, 'dependencies', n, g, false, n = 'n2' from p, (values ('workspace-root:', '', 'n1', '1'), ('workspace-root:', '', 'n2', '2'), ('n0', 'n0', 'n1', '1'), ('n0', 'n0', 'top', 'workspace:*')) as v(s, l, n, g)),
pl as (select ask.*, unnest(list_append(list_filter(list_transform(range(1, len(string_split(locator, '/')) + 1), lambda k: case when locator <> '' and (k = len(string_split(locator, '/')) or not starts_with(string_split(locator, '/')[k], '@')) then array_to_string(string_split(locator, '/')[1:k], '/') || '/' end), lambda x: x is not null), '')) as place from ask where not differs),
fd as (select pl.root, source, kind, name, 'lock:' || arg_max(g.locator, length(place)) as target from pl join good g on g.root = pl.root and g.locator = place || name group by 1, 2, 3, 4),
ed as (select ask.root, source, kind, name, range, optional, coalesce(target, case when range like 'workspace:%' then 'workspace-root:' else '-' end) as target from ask left join fd using (root, source, kind, name))"""

QUERIES = {
    "lock_edges": (lock_edges, f"{_ENTRIES} select * from ed"),
    "lock_issues": (lock_issues, f"{_ENTRIES} select root, 'unreadable-entry' as issue, locator as subject from q where j % 11 = 10 union all select root, 'unsupported-descriptor', locator from q where j % 11 <> 10 and j % 13 = 12 union all select root, 'missing-metadata', locator from good where j % 17 = 16 union all select distinct root, 'manifest-differs', 'top dependencies.n2' from p union all select root, 'unresolved', count(*)::varchar from ed where target = '-' group by 1"),
}
