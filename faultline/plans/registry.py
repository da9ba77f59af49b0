"""The queries this package registers, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import VIEWS, view, with_clause

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


class Inputs:
    """Derived views by attribute: ``Inputs(spark, dir).v_log``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._seen = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = view(self.spark, self.sf_dir, name)
        return self._seen[name]


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn(inputs) -> DataFrame``; ``sql`` may use the views and ``ctes``."""

    def add(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            head = with_clause(ctes + " " + sql)
            body = (head + ", " if head != "with " else "with ") + ctes if ctes else (head if head != "with " else "")
            CHECKS[name] = f"{body} {sql}".strip()
        return fn

    return add


__all__ = ["CHECKS", "QUERIES", "VIEWS", "Inputs", "query"]
