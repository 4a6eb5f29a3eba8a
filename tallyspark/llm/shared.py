"""Folders that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..folders import shared_folder

T = TypeVar("T")
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Deletes all folders that operators have made in this process. Results read some of them until they are written, so
    only the caller knows when."""
    while _made:
        _delete(spark, _made.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what runs inside as soon as it has ended, and not when the driver's objects for
    them happen to be collected."""
    held = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, held)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and read again by whoever needs it, also after executors are
    lost."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with dropping_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for table in tables:
        _delete(spark, table._folder)
        if table._folder in _made:
            _made.remove(table._folder)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what goes to a Python worker at once by bytes, besides rows: otherwise 10,000 long texts would be one batch.
    A lower bound that the session has stays."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run; when the task has ended, the memory that it freed goes back to the system, as workers outlive their tasks."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def in_worker(key: tuple, make: Callable[[], T]) -> T:
    """An object that a Python worker keeps from task to task, such as a vocabulary's tables: one at a time, the last one
    asked for. The module that holds it is the process's own, as functions come to it by value."""
    state = sys.modules.setdefault("_tallyspark_worker", types.ModuleType("_tallyspark_worker"))
    if getattr(state, "key", None) != key:
        state.key = state.held = None  # the old one goes before the new one is made
        state.held = make()
        state.key = key
    return state.held


def parts(spark: SparkSession) -> int:
    """Into how many parts to deal: as many as the session's shuffles have, which grows with the cluster's input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
