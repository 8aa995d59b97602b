"""Named queries and, where SQL can say the same, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries under unique names."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str | None = None, oracle: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"query {key} is registered twice")
            self.queries[key] = f
            if oracle is not None:
                self.oracles[key] = oracle
            return f

        return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder; columns and filters are pushed down by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
