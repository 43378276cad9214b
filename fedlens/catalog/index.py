"""All named queries and their SQL."""

from __future__ import annotations

from fedlens.catalog import combining, experiment, logs, poisoning, reporting, scoring, streams

MODULES = (scoring, combining, poisoning, logs, reporting, experiment, streams)


def all_queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
