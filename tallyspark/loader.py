"""load(): a file to a Table."""

from __future__ import annotations

import sys
import time
from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.query import IngestReport, Table
from .sources.delimited import ROW, read_delimited


def load(
    path: str,
    sep: str = "\t",
    schema: Mapping[str, str] | None = None,
    max_rows: int = 0,
    verbose: bool = False,
    has_header: bool = True,
    spark: SparkSession | None = None,
) -> Table:
    """See sources.delimited.read_delimited. Parquet paths (*.parquet) are read with their own columns. verbose reads
    the whole input once and reports on stderr."""
    spark = spark or SparkSession.builder.getOrCreate()
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("n")).alias(ROW)
        df = df.select("*", place)
        table = Table(df.orderBy(ROW).limit(max_rows) if max_rows else df)
    else:
        table = Table(read_delimited(spark, path, sep, schema, max_rows, has_header))
    if verbose:
        print(report(table, path), file=sys.stderr)
    return table


def report(table: Table, path: str) -> IngestReport:
    """Reads and parses all rows; rows, MB of source, seconds, and MB that the columns take in memory."""
    spark, began = table.df.sparkSession, time.perf_counter()
    parsed = table.df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*(f"`{c}`" for c in table.columns)))).head()
    seconds = time.perf_counter() - began
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return IngestReport(parsed[0], size / 1e6, seconds, table.resident_mb)
