"""Every operator as a query on the given tables, with the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Suite:
    """Named queries and, where SQL can express them, their SQL text."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql.strip()
            return query

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def all_suites() -> list[Suite]:
    from . import associations, catalogue, cleaning, consolidation, io, learning, profiles, quality

    return [m.suite for m in (profiles, associations, quality, cleaning, consolidation, catalogue, io, learning)]


def all_queries() -> dict[str, Query]:
    return {k: q for s in all_suites() for k, q in s.queries.items()}


def all_sql() -> dict[str, str]:
    return {k: q for s in all_suites() for k, q in s.sql.items()}
