"""Named queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    covers: tuple[str, ...]


_QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under its own name. ``covers`` lists the operator ids it exercises."""

    def add(build: Builder) -> Builder:
        name = build.__name__
        if name in _QUERIES:
            raise ValueError(f"query {name} is already registered")
        _QUERIES[name] = Query(name, build, sql, tuple(covers.split()))
        return build

    return add


def catalogue() -> dict[str, Query]:
    from zonetide.plans import (  # noqa: F401  (registration happens on import)
        queries_decisions,
        queries_features,
        queries_joins,
        queries_learning,
        queries_outcomes,
        queries_quality,
        queries_reports,
        queries_sources,
        queries_streams,
    )

    return dict(_QUERIES)
