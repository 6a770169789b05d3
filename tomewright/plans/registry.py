"""All catalog queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "list_page"


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame, and its DuckDB SQL."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add
