"""Queries of this package, each with its check in SQL where one exists."""

from __future__ import annotations

from cliptide.plans.registry import Query

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return register
