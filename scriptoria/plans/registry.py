"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    covers: tuple[str, ...]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query; ``covers`` lists the inventory ids it exercises."""

    def register(build: Builder) -> Builder:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = Query(name, build, tuple(covers.split()), sql)
        return build

    return register


def registered() -> dict[str, Query]:
    from scriptoria.plans import catalogue  # noqa: F401  (registers on import)

    return dict(_QUERIES)
