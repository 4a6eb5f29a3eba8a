"""COUNT, SUM, AVG, MIN and MAX, over all rows or by one key.

Each result has the number of rows and one double. Metrics are summed as doubles; MIN and MAX skip NaN (with nothing
else, they are +inf and -inf). Without a key there is one row even for no input, with 0 and 0.0; with a key there are
only groups that have rows.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FLOAT64


class Agg(Enum):
    COUNT = "COUNT"
    SUM = "SUM"
    AVG = "AVG"
    MIN = "MIN"
    MAX = "MAX"


def aggregate_columns(agg: Agg, metric: str | None, kind: str | None) -> list[Column]:
    """count bigint, value double."""
    count = F.count(F.lit(1))
    if agg is Agg.COUNT:
        return [count.alias("count"), count.cast("double").alias("value")]
    at = F.col(f"`{metric}`").cast("double")
    if agg is Agg.SUM:
        value = F.coalesce(F.sum(at), F.lit(0.0))
    elif agg is Agg.AVG:
        value = F.coalesce(F.avg(at), F.lit(0.0))
    else:
        best, none = (F.min, float("inf")) if agg is Agg.MIN else (F.max, float("-inf"))
        seen = best(F.when(~F.isnan(at), at)) if kind == FLOAT64 else best(at)
        value = F.coalesce(seen, F.when(count > 0, F.lit(none)).otherwise(F.lit(0.0)))
    return [count.alias("count"), value.alias("value")]


def reduce_all(df: DataFrame, agg: Agg, metric: str | None = None, kind: str | None = None) -> DataFrame:
    return df.agg(*aggregate_columns(agg, metric, kind))


def reduce_by(df: DataFrame, key: Column, agg: Agg, metric: str | None = None, kind: str | None = None, row: str | None = None) -> DataFrame:
    """(key, count, value), and first, the group's first row, if row is given."""
    extra = [F.min(row).alias("first")] if row else []
    return df.groupBy(key.alias("key")).agg(*aggregate_columns(agg, metric, kind), *extra)
