"""First-appearance dictionaries: category to code, in the order in which categories first occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_seen(df: DataFrame, column: str, row: str) -> DataFrame:
    """(key, first): one row per category, with the place of its first row. Partial aggregation before the shuffle."""
    return df.groupBy(F.col(f"`{column}`").alias("key")).agg(F.min(row).alias("first"))


def _stretch(df: DataFrame, row: str) -> Column:
    """Cuts the rows' order into stretches of bounded size: of a file's split, or of a million numbered rows. Rows ordered
    by anything else are one stretch."""
    kind = df.schema[row].dataType
    if isinstance(kind, T.IntegralType):
        return F.shiftright(F.col("first"), 20)
    if isinstance(kind, T.StructType) and kind.fields and isinstance(kind.fields[-1].dataType, T.LongType):
        return F.struct(*(F.col(f"first.{f.name}") for f in kind.fields[:-1]), F.shiftright(F.col(f"first.{kind.fields[-1].name}"), 20).alias("n"))
    return F.lit(0)


def codes(df: DataFrame, column: str, row: str) -> DataFrame:
    """(key, code bigint from 0). The rank is distributed, and the same whenever it is computed again: places are numbered
    within stretches of the rows' order, and shifted by the categories of the stretches before."""
    seen = first_seen(df, column, row).select("key", "first", _stretch(df, row).alias("part"))
    inside = Window.partitionBy("part").orderBy("first")
    ranked = seen.select("key", "part", (F.row_number().over(inside) - 1).alias("n"))
    sizes = seen.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    shifts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    return ranked.join(shifts, "part").select("key", (F.col("n") + F.col("shift")).cast("bigint").alias("code"))


def encode(df: DataFrame, column: str, row: str) -> DataFrame:
    """df with the column's code as `<column>_code`."""
    coded = codes(df, column, row).select(F.col("key").alias(column), F.col("code").alias(f"{column}_code"))
    return df.join(coded, column)


def lookup(df: DataFrame, column: str, value: str, row: str) -> int:
    """The value's code, -1 if it doesn't occur."""
    found = codes(df, column, row).where(F.col("key") == F.lit(value)).head(1)
    return found[0]["code"] if found else -1


def decode(df: DataFrame, column: str, code: int, row: str) -> str:
    """The category with this code; IndexError if there is none."""
    found = codes(df, column, row).where(F.col("code") == F.lit(code)).head(1)
    if not found:
        raise IndexError(f"{column} has no code {code}")
    return found[0]["key"]
