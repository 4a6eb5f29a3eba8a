"""Group keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FLOAT64


def numeric_key(column: str, kind: str, bucket: int) -> Column:
    """A bigint key. Floats lose their fraction first (toward zero; NaN and what bigint can't hold become null, shown
    as "nan"). With a bucket, the key is the multiple of it nearest to the value toward zero: -1 and 1 share bucket 0."""
    key = F.col(f"`{column}`")
    key = key.try_cast("bigint") if kind == FLOAT64 else key.cast("bigint")
    return F.call_function("div", key, F.lit(bucket).cast("bigint")) * F.lit(bucket).cast("bigint") if bucket else key


def shown_key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("nan"))
