"""The queries that __spark_entry__ adds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as _queries

Run = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Run]:
    return {name: run for name, run in vars(_queries).items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(getattr(_queries, "ORACLE_SQL", {}))
