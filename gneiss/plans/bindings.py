"""Binds the operators to the tables of a data folder, each with the SQL that gives the same rows."""

from __future__ import annotations

from . import cuts, extra, facts, graphs, internal, logs, manifests, records, repository, shapes, views

_MODULES = (facts, records, views, graphs, shapes, logs, repository, cuts, extra, internal, manifests)


def queries() -> dict:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
