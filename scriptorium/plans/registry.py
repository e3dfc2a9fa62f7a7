"""The queries over the reference's own operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    """Register a query under its function's name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    run.__name__, run.__doc__, run.plain = function.__name__, function.__doc__, function
    QUERIES[function.__name__] = run
    return run


def load() -> None:
    """Import the modules that register queries and SQL."""
    from scriptorium.plans import oracle, queries  # noqa: F401
