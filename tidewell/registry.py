"""Queries of the price-cycle library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.shipping import ship
from tidewell.sources.adapter import PRELUDE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True):
    """Register a function of Tables as a query, by its name; sql may use the tables of PRELUDE."""

    def put(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = PRELUDE + sql.strip().replace("WITH ", ", ", 1) if prelude and sql.strip().startswith("WITH ") else (PRELUDE + sql if prelude else sql)
        return f

    return put


from tidewell.plans import cleaning, evaluation, experiments, learning, panel, series, simulation, storage, streams  # noqa: E402, F401
