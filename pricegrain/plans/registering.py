"""A list of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Queries:
    """prefix: common table expressions that every statement may use."""

    def __init__(self, prefix: str = ""):
        self.prefix = prefix
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is there already")
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = f"{self.prefix}\n{sql}"
