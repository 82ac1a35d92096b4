"""Registry of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from orefield.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with the equivalent SQL where SQL can express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(function: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name!r} is registered twice")

            @wraps(function)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship_package(spark)
                return function(spark, sf_dir)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return function

        return register


CORE = Registry()
