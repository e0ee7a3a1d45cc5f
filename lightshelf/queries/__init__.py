"""Queries that apply the operators to the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            assert name not in self.queries, name
            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return put


def every() -> Registry:
    from lightshelf.queries import catalogue, curation, people, retrieval, similar, timeline, upkept

    out = Registry()
    for module in (catalogue, people, timeline, similar, retrieval, curation, upkept):
        out.queries |= module.REGISTRY.queries
        out.sql |= module.REGISTRY.sql
    return out
