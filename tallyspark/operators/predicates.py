"""Comparisons of a column with a constant.

Numbers compare as doubles, with IEEE rules for NaN: only != holds. Categories compare by == and != as strings; the four
range operators compare the order of first appearance in the whole table, whatever other tests there are; a constant that never
appears comes before all others. A missing value (null) is 0, 0.0 or "".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DICT, FLOAT64
from .dictionary import codes, first_seen

OPERATORS = {
    "==": "==", "eq": "==", "!=": "!=", "ne": "!=", "<": "<", "lt": "<", "<=": "<=", "le": "<=", ">": ">", "gt": ">", ">=": ">=", "ge": ">=",
}
EXACT = 2**53


def operator_of(op: str) -> str:
    if op not in OPERATORS:
        raise ValueError(f"unknown operator: {op!r}")
    return OPERATORS[op]


def compare(left: Column, op: str, right: Column) -> Column:
    return {
        "==": left.__eq__, "!=": left.__ne__, "<": left.__lt__, "<=": left.__le__, ">": left.__gt__, ">=": left.__ge__,
    }[op](right)


def _holds(left: float | str, op: str, right: float | str) -> bool:
    return {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def _or_default(test: Column, at: Column, holds: bool) -> Column:
    """A missing value is its type's default. Written as a test of the column itself, which Parquet can skip rows by."""
    return (test | at.isNull()) if holds else test


def numeric(column: str, kind: str, op: str, value: float) -> Column:
    """A whole constant is compared with an integer column as it is: the result is the same and Parquet can skip rows
    by it, which a cast of the column would prevent."""
    at = F.col(f"`{column}`")
    if math.isnan(value):
        return F.lit(op == "!=")
    holds = _holds(0.0, op, value)
    if kind == FLOAT64:
        test = compare(at, op, F.lit(value))
        return _or_default(test if op in ("!=", "==", "<", "<=") else test & ~F.isnan(at), at, holds)  # Spark has NaN above all numbers
    if math.isfinite(value) and value == int(value) and abs(value) < EXACT:
        return _or_default(compare(at, op, F.lit(int(value))), at, holds)
    return _or_default(compare(at.cast("double"), op, F.lit(value)), at, holds)


def equality(column: str, op: str, value: str) -> Column:
    at = F.col(f"`{column}`")
    return _or_default(compare(at, op, F.lit(value)), at, _holds("", op, value))


def category(df: DataFrame, whole: DataFrame, column: str, op: str, value: str, row: str) -> DataFrame:
    """The rows of df that pass a range; the order of first appearance is that of the whole table. The categories that
    pass are joined, one row each; AQE picks the join's kind by the measured size, so a large dictionary is never forced
    into a broadcast. The constant's own place is a scalar of the same plan, null where it never appears."""
    places = first_seen(whole, column, row)
    mine = places.where(F.col("key") == F.lit(value)).agg(F.max("first").alias("mine")).scalar()
    test = compare(F.col("first"), op, mine)
    passing = places.where(test | mine.isNull() if op in (">", ">=") else test).select(F.col("key").alias(column))
    return df.join(passing, column, "left_semi").select(*df.columns)


def category_code(df: DataFrame, whole: DataFrame, column: str, op: str, code: float, row: str) -> DataFrame:
    """Category against a number: the number, without its fraction, is compared with the code of first appearance."""
    passing = codes(whole, column, row).where(compare(F.col("code"), op, F.lit(int(code)))).select(F.col("key").alias(column))
    return df.join(passing, column, "left_semi").select(*df.columns)


def pushable(column: str, kind: str, op: str, value: float | str) -> Column | None:
    """The test as an expression of its column, where it is one."""
    if kind != DICT:
        if isinstance(value, str):
            raise TypeError(f"column {column} holds numbers; it can't be compared with {value!r}")
        return numeric(column, kind, op, float(value))
    return equality(column, op, value) if op in ("==", "!=") and isinstance(value, str) else None


def passing_rows(df: DataFrame, whole: DataFrame, column: str, op: str, value: float | str, row: str) -> DataFrame:
    """The rows of df that pass a test of a category's place in the dictionary of the whole table."""
    if isinstance(value, str):
        return category(df, whole, column, op, value, row)
    return category_code(df, whole, column, op, value, row)
