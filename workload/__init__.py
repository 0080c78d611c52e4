"""The registered queries, by area, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload import audit, layers, runs, text, units

Query = Callable[[SparkSession, str], DataFrame]
AREAS = [layers, text, audit, runs, units]


def queries() -> dict[str, Query]:
    return {name: query for area in AREAS for name, query in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.ORACLES.items()}
