"""Filters of record tables: every part of a query that is not given selects all rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import contains_text, has_pairs, has_tags

ANY: Any = object()  # a part that is not given, where None has a meaning of its own


def _is(column: str, wanted) -> Column:
    """Equal to a value or one of a list of values; all rows for None."""
    if wanted is None:
        return F.lit(True)
    return F.coalesce(F.col(column).isin(*wanted) if isinstance(wanted, (list, tuple, set)) else F.col(column) == wanted, F.lit(False))


def _links(column: str, wanted: dict[str, Any]) -> Column:
    """Every wanted field of a struct equals its value; a value of None asks for null."""
    out = F.lit(True)
    for name, value in wanted.items():
        out &= F.col(f"{column}.{name}").eqNullSafe(F.lit(value))
    return out


@dataclass(frozen=True)
class RunQuery:
    queue: str | None = None
    status: Any = None
    tags: dict[str, str] = field(default_factory=dict)
    definition: str | None = None
    links: dict[str, Any] = field(default_factory=dict)
    search: str | None = None


def runs(df: DataFrame, q: RunQuery) -> DataFrame:
    """Runs (id, queue, step, definition, status, tags, links with session, invocation and subject) that fit a query; the text is looked for in seven fields."""
    text = (q.search or "").strip()
    seven = ("id", "queue", "step", "definition", "links.session", "links.invocation", "links.subject")
    found = contains_text(text, *seven) if text else F.lit(True)
    return df.filter(_is("queue", q.queue) & found & _is("status", q.status) & has_pairs(F.col("tags"), q.tags) & _is("definition", q.definition) & _links("links", q.links))


def jobs(df: DataFrame, status=None, definition: str | None = None, links: dict[str, Any] | None = None) -> DataFrame:
    return df.filter(_is("status", status) & _is("definition", definition) & _links("links", links or {}))


def suspensions(df: DataFrame, run=None, kind: str | None = None, name: str | None = None, occurrence: int | None = None, step_path: list[str] | None = None, status=None) -> DataFrame:
    """Suspensions that fit; a step path fits if it is equal item by item."""
    path = F.lit(True) if step_path is None else F.coalesce(F.col("step_path") == F.array(*map(F.lit, step_path)).cast("array<string>"), F.lit(False))
    return df.filter(_is("run", run) & _is("kind", kind) & _is("name", name) & _is("occurrence", occurrence) & path & _is("status", status))


def tasks(df: DataFrame, status: str | None = None, parent=ANY, every: list[str] = (), some: list[str] = ()) -> DataFrame:
    """Tasks of a status, with a parent (None: roots), and with every one of some tags and any of others."""
    above = F.lit(True) if parent is ANY else F.col("parent_id").eqNullSafe(F.lit(parent))
    return df.filter(_is("status", status) & above & has_tags(F.col("tags"), list(every), list(some)))


def artifacts(df: DataFrame, text: str | None = None, kind: str | None = None, archived: bool = False) -> DataFrame:
    """Artifacts (id, name, type, archived_at) of a type whose name, type or id holds a text; archived ones only where asked for."""
    there = F.lit(True) if archived else F.col("archived_at").isNull()
    return df.filter(there & _is("type", kind) & (contains_text(text, "name", "type", "id") if text else F.lit(True)))


def directions(df: DataFrame, from_=None, to=None, role=None, least: int | None = None) -> DataFrame:
    """Directions (id, from, to, role, count), largest count first, then by id."""
    rows = df.filter(_is("from", from_) & _is("to", to) & _is("role", role) & (F.lit(True) if least is None else F.col("count") >= least))
    return rows.orderBy(F.desc("count"), "id")


def reviews(df: DataFrame, disposition=None, baseline: bool | None = None, declared=None, center=None) -> DataFrame:
    return df.filter(_is("disposition", disposition) & _is("baseline_dominated", baseline) & _is("declared_package", declared) & _is("gravity_center", center)).orderBy("id")


def patterns(df: DataFrame, family=None, kind: str | None = None, package: str | None = None, strength=None) -> DataFrame:
    """Patterns (id, family, kinds, packages, strength) that hold a kind and a package."""
    holds = lambda c, v: F.lit(True) if v is None else F.coalesce(F.array_contains(c, v), F.lit(False))
    return df.filter(_is("family", family) & holds("kinds", kind) & holds("packages", package) & _is("strength", strength))


def recall(df: DataFrame, text: str, kind=None, limit: int = 10, offset: int = 0) -> DataFrame:
    """Page of memories (id, kind, text, created_at) that hold a text, newest first, each with score 1."""
    rows = df.filter(_is("kind", kind) & contains_text(text, "text")).withColumn("score", F.lit(1.0))
    return rows.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def feed(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("posted_at"), "id").limit(limit)


def recoverable(df: DataFrame, queue, live: tuple[str, ...] = ("queued", "running", "suspended")) -> DataFrame:
    """Runs (id, queue, status, created_at) of a queue that were not over, newest first."""
    return df.filter(_is("queue", queue) & F.col("status").isin(*live)).orderBy(F.desc("created_at"), F.desc("id"))
