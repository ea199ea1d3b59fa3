"""A table of queries with the SQL that checks each."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import join_by_measured_sizes
from ..sources.derived import CTE


class Book:
    """Collects queries; sql is DuckDB SQL over the derived tables cat, foc, hyp, meta and foct (see sources.derived)."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, more: str = "", recursive: bool = False) -> Callable:
        def keep(f: Callable) -> Callable:
            @functools.wraps(f)
            def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
                join_by_measured_sizes(spark)
                return f(spark, sf_dir)

            self.queries[name] = planned
            if sql:
                self.sql[name] = f"WITH {'RECURSIVE ' * recursive}{CTE}{', ' + more if more else ''} {sql}"
            return f

        return keep
