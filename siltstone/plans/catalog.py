"""Registry of the engine's queries and of the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.tables import register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query given as Spark SQL; ``oracle`` is its DuckDB spelling where the two differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, text)
        return spark.sql(text)

    run.__name__ = name
    run.__doc__ = text
    QUERIES[name] = run
    ORACLE[name] = oracle or text


def frame_query(oracle: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its own name; ``oracle`` is the DuckDB SQL for its rows."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLE[function.__name__] = oracle
        return function

    return add


def load() -> None:
    """Import the modules that register queries."""
    from siltstone.plans import aggregation, joins, operators, projection, scalars, scalars_more, sets, windows  # noqa: F401


load()
