"""Delimited text to a typed DataFrame.

Spark's CSV reader can't give these semantics (no quoting, header bound by name, lines of delimiters kept, no nulls), so
lines are read as text and split by expressions; the scan stays splittable and all work is in the JVM. Text can't be
pruned by column: write the loaded frame to Parquet once to query it often.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import as_typed
from ..schema import resolve

#: Hidden column with each row's place in the input; orders rows within and across files.
ROW = "__row"


def split_line(line: Column, sep: str) -> Column:
    """A pattern of one character, escaped unless it is a letter, a digit or white space, is split by without a regex."""
    return F.split(line, sep if sep.isalnum() or sep.isspace() else f"\\{sep}", -1)


def without_cr(line: Column) -> Column:
    """One carriage return at the end goes."""
    return F.when(line.endswith("\r"), F.left(line, F.length(line) - 1)).otherwise(line)


def typed_fields(lines: DataFrame, positions: Mapping[str, int], schema: Mapping[str, str], sep: str) -> DataFrame:
    """lines: value string, and ROW. Short lines get defaults, surplus fields are ignored."""
    fields = lines.select(split_line(F.col("value"), sep).alias("f"), ROW)
    return fields.select(*(as_typed(F.get("f", F.lit(i)), schema[name]).alias(name) for name, i in positions.items()), ROW)


def bind_header(header: str, schema: Mapping[str, str], sep: str) -> dict[str, int]:
    """Positions of the schema's columns, in the file's order. Names match exactly; of repeated names the last counts."""
    names = header.removesuffix("\r").split(sep)
    places = {name: i for i, name in enumerate(names)}
    return {name: i for i, name in enumerate(names) if name in schema and places[name] == i}


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = "\t",
    schema: Mapping[str, str] | None = None,
    max_rows: int = 0,
    has_header: bool = True,
) -> DataFrame:
    """A frame with the schema's columns that the file has, in the file's order, and ROW. Only the first character of
    sep counts; an empty one is a tab. Blank lines are skipped, and one "\\r" at a line's end. Without a header the
    schema's order is the fields' order. A path with several files takes each file's first line as its header: one line is
    dropped from each file that begins with the same header, however often it is repeated. max_rows 0 is no limit."""
    sep, kinds = sep[:1] or "\t", resolve(schema)
    if max_rows:
        path = _first_files(spark, path, max_rows, has_header)
    lines = spark.read.option("lineSep", "\n").text(path)
    start = F.col("_metadata.file_block_start")
    lines = lines.select(
        without_cr(F.col("value")).alias("value"),
        F.struct(F.col("_metadata.file_path").alias("file"), start.alias("at"), F.monotonically_increasing_id().alias("n")).alias(ROW),
    )
    positions = {name: i for i, name in enumerate(kinds)}
    if has_header:
        first = lines.where(F.col(f"{ROW}.at") == 0).head(1)
        header = first[0]["value"] if first else ""
        positions = bind_header(header, kinds, sep)
        lines = _without_header(lines, header, len(lines.inputFiles()))
    lines = lines.where(F.length("value") > 0)
    return typed_fields(lines.orderBy(ROW).limit(max_rows) if max_rows else lines, positions, kinds, sep)


def _first_files(spark: SparkSession, path: str, rows: int, has_header: bool) -> list[str] | str:
    """Of a folder's files, in the order of their names, as many as hold so many rows, so that others aren't read."""
    files = sorted(spark.read.text(path).inputFiles())
    n = 1
    while n < len(files):
        found = spark.read.option("lineSep", "\n").text(files[:n]).where("value not in ('', '\\r')")
        if found.limit(rows + n * has_header).count() >= rows + n * has_header:
            return files[:n]
        n *= 2
    return files if len(files) > 1 else path


def _without_header(lines: DataFrame, header: str, n_files: int) -> DataFrame:
    """A file's first line is the first of a split that begins at 0. With one file that split is the first partition's;
    of several files, small ones share partitions, and the place is looked up."""
    same = (F.col(f"{ROW}.at") == 0) & (F.col("value") == F.lit(header))
    if n_files <= 1:
        return lines.where(~same | (F.col(f"{ROW}.n") != 0))
    firsts = lines.where(same).groupBy(F.col(f"{ROW}.file").alias("file")).agg(F.min(f"{ROW}.n").alias("n"))
    mine = (F.col(f"{ROW}.file") == F.col("file")) & (F.col(f"{ROW}.n") == F.col("n"))
    return lines.join(firsts, mine, "left_anti")
