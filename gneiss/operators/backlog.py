"""Tasks and their dependencies: availability, readiness, tree expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut


def blockers(tasks: DataFrame, deps: DataFrame, settled: list[str]) -> DataFrame:
    """(task_id, depends_on_id) of dependencies on tasks that are not settled; a dependency that is no task blocks nothing."""
    open_ = tasks.filter(~F.col("status").isin(settled)).select(F.col("id").alias("depends_on_id"))
    return deps.select("task_id", "depends_on_id").distinct().join(open_, "depends_on_id", "left_semi")


def open_ancestors(tasks: DataFrame, open_status: str = "open") -> DataFrame:
    """(id, ancestor): every ancestor of a task, however far up, that is open; a task on a parent cycle is not its own."""
    up = cut(tasks.filter("parent_id is not null").select("id", F.col("parent_id").alias("ancestor")).join(tasks.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id", "ancestor"))
    found = front = up
    while True:
        step = front.select("id", F.col("ancestor").alias("via")).join(up.select(F.col("id").alias("via"), "ancestor"), "via").select("id", "ancestor")
        front = cut(step.filter("id <> ancestor").distinct().join(found, ["id", "ancestor"], "left_anti"))
        if front.isEmpty():
            break
        found = cut(found.union(front))
    open_ = tasks.filter(F.col("status") == open_status).select(F.col("id").alias("ancestor"))
    return found.filter("id <> ancestor").join(open_, "ancestor", "left_semi").select("id", "ancestor")


def availability(tasks: DataFrame, deps: DataFrame, settled: list[str], active: list[str], parent_gate: bool = False, open_status: str = "open") -> DataFrame:
    """(id, availability, blocked_by, waiting_on): settled, active, blocked or ready; the two lists hold sorted ids.

    tasks is (id, status, parent_id); deps (task_id, depends_on_id). blocked_by are unsettled
    dependencies, waiting_on, with the parent gate, open ancestors; either blocks an open task.
    """
    by = blockers(tasks, deps, settled).groupBy(F.col("task_id").alias("id")).agg(F.array_sort(F.collect_set("depends_on_id")).alias("_b"))
    out = tasks.join(by, "id", "left")
    if parent_gate:
        out = out.join(open_ancestors(tasks, open_status).groupBy("id").agg(F.array_sort(F.collect_set("ancestor")).alias("_w")), "id", "left")
    else:
        out = out.withColumn("_w", F.lit(None).cast(f"array<{tasks.schema['id'].dataType.simpleString()}>"))
    held = F.col("_b").isNotNull() | F.col("_w").isNotNull()
    label = F.when(F.col("status").isin(settled), "settled").when(F.col("status").isin(active), "active").when(held, "blocked").otherwise("ready")
    none = F.array().cast(f"array<{tasks.schema['id'].dataType.simpleString()}>")
    lists = [F.when(label == "blocked", F.coalesce(c, none)).otherwise(none).alias(n) for c, n in (("_b", "blocked_by"), ("_w", "waiting_on"))]
    return out.select("id", label.alias("availability"), *lists)


def below_open(tasks: DataFrame, open_status: str = "open") -> DataFrame:
    """Ids of tasks with an open ancestor other than themselves, however far up.

    Each round doubles the distance looked up, carrying the least and the largest open id met, so
    parent cycles end once the distance reaches the number of tasks.
    """
    open_ = F.when(F.col("status") == open_status, F.col("id"))
    own = tasks.select("id", F.col("parent_id").alias("up"), open_.alias("_o"))
    first = own.select("id", "up").join(own.select(F.col("id").alias("up"), F.col("_o").alias("lo")), "up", "left")
    state = cut(first.select("id", "up", "lo", F.col("lo").alias("hi")))
    reach, most = 1, state.count()
    while reach < most and not state.filter("up is not null").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("lo").alias("l"), F.col("hi").alias("h"))
        moved = state.filter("up is not null").join(above, "up", "left").select("id", F.col("next").alias("up"), F.least("lo", "l").alias("lo"), F.greatest("hi", "h").alias("hi"))
        state = cut(state.filter("up is null").unionByName(moved))
        reach *= 2
    return state.filter("lo <> id or hi <> id").select("id")


def ready(tasks: DataFrame, deps: DataFrame, settled: list[str], open_status: str = "open", parent_gate: bool = True) -> DataFrame:
    """Open tasks (id, status, parent_id) without unsettled dependencies and, with the parent gate, without open ancestors."""
    out = tasks.filter(F.col("status") == open_status).select("id").join(blockers(tasks, deps, settled).select(F.col("task_id").alias("id")).distinct(), "id", "left_anti")
    return out.join(below_open(tasks, open_status), "id", "left_anti") if parent_gate else out


def expand(tasks: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, id, level) of the descendants of roots down to a depth."""
    level = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("level"))
    out = level
    for d in range(1, depth + 1):
        level = tasks.select("id", F.col("parent_id").alias("_p")).join(level.select("root", F.col("id").alias("_p")), "_p").select("root", "id", F.lit(d).alias("level"))
        out = out.union(level)
    return out


def fresh_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (id, expected, ...) whose expected revision is the current one (id, revision)."""
    return changes.join(current.select("id", F.col("revision").alias("expected")), ["id", "expected"], "left_semi")
