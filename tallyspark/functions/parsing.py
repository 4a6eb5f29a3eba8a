"""Text fields to typed columns, as JVM expressions only.

A number is read from the longest valid prefix of its field ("12abc" is 12); a field without such a prefix, or with one
that is out of range, is 0. A leading "+" or blank is no part of a number. A missing field is 0, 0.0 or "".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DICT, INT64

INT_PREFIX = r"^-?[0-9]+"
FLOAT_PREFIX = r"^-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
WORD_PREFIX = r"(?i)^-?(?:inf|nan)"


def _plain(field: Column, kind: str) -> Column:
    """A cast alone, for fields that begin like a number; null for those that it can't read. Most fields end here."""
    return F.when(F.ascii(field).between(45, 57), field.try_cast(kind))  # from "-" to "9"


def as_int64(field: Column) -> Column:
    return F.coalesce(_plain(field, "bigint"), F.regexp_extract(field, INT_PREFIX, 0).try_cast("bigint"), F.lit(0).cast("bigint"))


def as_float64(field: Column) -> Column:
    def finite(number: Column) -> Column:  # out of range is 0
        return F.when(F.abs(number) < F.lit(float("inf")), number)

    word = F.lower(F.regexp_extract(field, WORD_PREFIX, 0))
    named = (
        F.when(word == "inf", F.lit(float("inf")))
        .when(word == "-inf", F.lit(float("-inf")))
        .when(word.isin("nan", "-nan"), F.lit(float("nan")))
    )
    hexadecimal = field.contains("x") | field.contains("X")  # which the cast would read
    plain = F.when(~hexadecimal, finite(_plain(field, "double")))
    return F.coalesce(plain, named, finite(F.regexp_extract(field, FLOAT_PREFIX, 0).try_cast("double")), F.lit(0.0))


def as_typed(field: Column, kind: str) -> Column:
    if kind == DICT:
        return F.coalesce(field, F.lit(""))
    return as_int64(field) if kind == INT64 else as_float64(field)
