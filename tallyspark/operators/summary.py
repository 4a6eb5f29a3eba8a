"""describe and head."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DICT, FLOAT64

WIDTHS = {"int64": 8, "float64": 8, "dict": 4}


def cardinalities(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """(column_name, distinct_values) of the categories, exact, in one pass: each row gives one (column, value) pair per
    category, which are made distinct before and after one shuffle."""
    names = [name for name, kind in kinds.items() if kind == DICT]
    pairs = F.array(*(F.struct(F.lit(name).alias("column_name"), F.col(f"`{name}`").alias("v")) for name in names))
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, distinct_values bigint")
    return df.select(F.inline(pairs)).distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))


def text_bytes(df: DataFrame, kinds: Mapping[str, str]) -> int:
    """Bytes of the columnar form: 8 a number, 4 a category's code, and each category once with 32 bytes beside it."""
    names = [name for name, kind in kinds.items() if kind == DICT]
    rows = df.count()
    total = rows * sum(WIDTHS[kind] for kind in kinds.values())
    if names:
        pairs = F.array(*(F.struct(F.lit(name).alias("c"), F.col(f"`{name}`").alias("v")) for name in names))
        found = df.select(F.inline(pairs)).distinct().agg(F.coalesce(F.sum(F.octet_length("v") + 32), F.lit(0))).head()
        total += int(found[0])
    return total


def describe(df: DataFrame, kinds: Mapping[str, str], rows: int, resident_mb: float) -> str:
    sizes = {r["column_name"]: r["distinct_values"] for r in cardinalities(df, kinds).collect()}  # a row per column
    out = [f"Table: {rows} rows x {len(kinds)} cols, {resident_mb:.1f} MB resident"]
    for name, kind in kinds.items():
        out.append(f"  {name:<22} {kind:<8}" + (f"  ({sizes.get(name, 0)} distinct)" if kind == DICT else ""))
    return "\n".join(out) + "\n"


def head(df: DataFrame, kinds: Mapping[str, str], row: str, n: int = 5) -> str:
    """The first n rows, tab-separated with a tab at each line's end; floats with six decimals."""
    shown = df.orderBy(row).limit(max(n, 0)).select(*(f"`{name}`" for name in kinds)).collect()
    cell = lambda v, kind: f"{v:.6f}" if kind == FLOAT64 else str(v)
    lines = ["".join(f"{name}\t" for name in kinds)]
    lines += ["".join(f"{cell(v, kind)}\t" for v, kind in zip(r, kinds.values(), strict=True)) for r in shown]
    return "\n".join(lines) + "\n"
