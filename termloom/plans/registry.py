"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.plans.driver_views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers a function of the driver's views under a name, with the DuckDB SQL for the same rows."""

    def register(function: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Views(spark, sf_dir))

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return function

    return register
