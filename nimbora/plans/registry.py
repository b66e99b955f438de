"""Registration of queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name; doubles named here are rounded on both sides, as sums differ in their order."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None, doubles: tuple[str, ...] = (), places: int = 8) -> None:
        """Registers one query."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = query(spark, sf_dir)
            return found.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in doubles}) if doubles else found

        self.queries[name] = run
        if sql is not None:
            replaced = ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in doubles)
            self.sql[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if doubles else sql
