"""Collects queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cataloom.workspace import table


class Queries:
    """``@q.add("name", sql)`` registers a function of a table getter ``t``."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.SQL: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda n: table(spark, sf_dir, n))

            run.__name__, run.__doc__ = name, f.__doc__
            self.QUERIES[name] = run
            if sql:
                self.SQL[name] = sql
            return f

        return keep
