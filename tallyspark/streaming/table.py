"""StreamingTable: rows go in one at a time, batches of them become visible as a whole, batch queries read what is visible.

insert() gathers lines on the driver. Full buffers wait, as Arrow tables, in a bounded queue; a thread of the driver makes
them visible one after the other and merges what is visible: so many of one size become one of the next size, so their
number grows with the logarithm of the batches. The first merge writes the lines of its batches as one file; the second
parses such files to a Parquet folder, by the same expressions as the bulk loader. Queries write the few batches that the
driver still holds as one more file and parse what isn't parsed yet. So a batch costs no Spark job and no file of its own.
Merged files and folders stay for queries that still read them.

Text files that others put into the source folder go through a Structured Streaming query, one file per micro-batch; a
replayed batch overwrites its own folder, so each row counts once. A blank line is a row of defaults in both.
"""

from __future__ import annotations

import functools
import itertools
import queue
import threading
import uuid
from collections.abc import Callable, Iterable, Mapping
from typing import TYPE_CHECKING, TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..folders import shared_folder, write_file
from ..plans.query import Table
from ..schema import SPARK_TYPES, resolve
from ..sources.delimited import ROW, bind_header, typed_fields, without_cr

if TYPE_CHECKING:
    import pyarrow as pa

R = TypeVar("R")
#: How many batches, files or folders of one size are merged to one of the next.
MERGE = 16
#: A row's place: its batch, and its number or its order there.
PLACE = T.StructField(ROW, T.StructType([T.StructField("batch", T.LongType()), T.StructField("n", T.LongType())]))


def _as_table(lines: list[str], number: int) -> pa.Table:
    import pyarrow as pa

    place = pa.StructArray.from_arrays([pa.repeat(pa.scalar(number, pa.int64()), len(lines)), pa.array(range(len(lines)), pa.int64())], ["batch", "n"])
    return pa.table({"value": pa.array(lines, pa.string()), ROW: place})


def _as_parquet(batches: list[pa.Table]) -> bytes:
    """Not as text: a row may hold line ends."""
    import pyarrow as pa
    from pyarrow import parquet

    out = pa.BufferOutputStream()
    parquet.write_table(pa.concat_tables(batches), out, use_dictionary=False, write_statistics=False, compression="zstd")
    return out.getvalue().to_pybytes()


class StreamingTable:
    def __init__(
        self,
        schema: Mapping[str, str] | None = None,
        flush_threshold: int = 10_000,
        delimiter: str = "\t",
        queue_capacity: int = 256,
        spark: SparkSession | None = None,
        path: str | None = None,
        header: str | None = None,
    ) -> None:
        """Fields are bound by the schema's order, or by the header line if one is given. path: a folder all executors
        share; by default one below spark.checkpoint.dir. At most queue_capacity full buffers wait to become visible; then
        insert() blocks until one of them is taken."""
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.kinds, self.sep = resolve(schema), delimiter[:1] or "\t"
        self.positions = bind_header(header, self.kinds, self.sep) if header else {n: i for i, n in enumerate(self.kinds)}
        self.threshold, self.capacity = max(1, flush_threshold), max(1, queue_capacity)
        self.root = f"{path or shared_folder(self.spark)}/stream-{uuid.uuid4().hex}"
        self._buffer: list[str] = []
        self._inserted = self._visible = self._arrived = self._flushed = 0  # rows inserted, visible, and both; batches
        self._numbers = itertools.count()  # of batches, in their order
        self._batches: set[int] = set()  # micro-batches that have ended
        # level, and path or the batch itself, in the order of their rows; replaced, never changed
        self._folders: list[tuple[int, str | pa.Table]] = []
        self._held: tuple[list[pa.Table], str] = ([], "")  # batches that were written for a query, and where
        self._lock = threading.Lock()
        self._waiting: queue.Queue[pa.Table | None] = queue.Queue(self.capacity)
        self._flusher: threading.Thread | None = None
        self._failure: Exception | None = None
        self._query = None

    # --- writing

    def insert(self, raw_row: str) -> None:
        self._buffer.append(raw_row)
        self._inserted += 1
        if len(self._buffer) >= self.threshold:
            self._hand_off()

    def insert_all(self, rows: Iterable[str]) -> None:
        for row in rows:
            self.insert(row)

    def _hand_off(self) -> None:
        self._raise_failure()
        if not self._buffer:
            return
        batch = _as_table(self._buffer, next(self._numbers))
        if self._flusher is None:
            self._flusher = InheritableThread(self._flush, session=self.spark, daemon=True)
            self._flusher.start()
        self._buffer = []
        self._waiting.put(batch)

    def _flush(self) -> None:
        """The flusher's thread, until it gets None. After a failure the rest is let go, so that nobody waits for it."""
        for batch in iter(self._waiting.get, None):
            try:
                if self._failure is None:
                    self._publish(self.spark, batch, batch.num_rows)
            except Exception as e:
                self._failure = e
            finally:
                self._waiting.task_done()
        self._waiting.task_done()

    def _raise_failure(self) -> None:
        if self._failure is not None:
            raise RuntimeError("a batch could not be flushed") from self._failure

    def _publish(self, spark: SparkSession, batch: str | pa.Table, rows: int) -> None:
        with self._lock:
            self._folders = [*self._folders, (0, batch)]
            self._visible += rows
            self._arrived += 0 if isinstance(batch, str) else rows
            self._flushed += 1
            self._folders = self._merged(spark, self._folders)

    def _start(self) -> None:
        source = self.spark.readStream.format("text").schema("value string").option("lineSep", "\n").option("maxFilesPerTrigger", 1)
        self._query = (
            source.load(f"{self.root}/source").writeStream.foreachBatch(self._apply).option("checkpointLocation", f"{self.root}/checkpoint").start()
        )

    def _apply(self, lines: DataFrame, batch: int) -> None:
        if batch in self._batches:  # it ended before
            return
        place = F.struct(F.lit(next(self._numbers)).cast("bigint").alias("batch"), F.monotonically_increasing_id().alias("n")).alias(ROW)
        out = f"{self.root}/table/batch={batch}"
        self._parsed(lines.select("value", place)).write.mode("overwrite").parquet(out)
        rows = lines.sparkSession.read.parquet(out).count()  # from the footers
        self._batches.add(batch)
        self._publish(lines.sparkSession, out, rows)

    def _is_raw(self, path: str) -> bool:
        """A file of inserted lines, which are not parsed yet."""
        return path.startswith(f"{self.root}/inserted/")

    def _written(self, spark: SparkSession, batches: list[pa.Table]) -> str:
        path = f"{self.root}/inserted/{uuid.uuid4().hex}.parquet"
        write_file(spark, path, _as_parquet(batches))
        return path

    def _written_once(self, spark: SparkSession, batches: list[pa.Table]) -> str:
        """For queries: no other file as long as the same batches are held."""
        held, path = self._held
        if [*map(id, held)] != [*map(id, batches)]:
            path = self._written(spark, batches)
            self._held = batches, path
        return path

    def _parsed(self, lines: DataFrame) -> DataFrame:
        return typed_fields(lines.select(without_cr(F.col("value")).alias("value"), ROW), self.positions, self.kinds, self.sep)

    def _rows(self, spark: SparkSession, folders: list[tuple[int, str | pa.Table]]) -> DataFrame:
        paths = [x for _, x in folders if isinstance(x, str)]
        raw, done = [x for x in paths if self._is_raw(x)], [x for x in paths if not self._is_raw(x)]
        if held := [x for _, x in folders if not isinstance(x, str)]:
            raw.append(self._written_once(spark, held))
        parts = [spark.read.schema(self._row_schema()).parquet(*done)] if done else []
        if raw:
            parts.append(self._parsed(spark.read.schema(T.StructType([T.StructField("value", T.StringType()), PLACE])).parquet(*raw)))
        return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], self._row_schema())

    def _merged(self, spark: SparkSession, folders: list[tuple[int, str | pa.Table]]) -> list[tuple[int, str | pa.Table]]:
        while len(folders) >= MERGE and folders[-MERGE][0] == folders[-1][0]:
            level, last = folders[-1][0] + 1, folders[-MERGE:]
            held = [x for _, x in last if not isinstance(x, str)]
            if len(held) == MERGE:
                path = self._written(spark, held)
            else:
                path = f"{self.root}/table/merged-{uuid.uuid4().hex}"
                self._rows(spark, last).coalesce(max(1, 4 * (level - 1))).write.parquet(path)
            folders = [*folders[:-MERGE], (level, path)]
        return folders

    def _row_schema(self) -> T.StructType:
        return T.StructType([*(T.StructField(name, SPARK_TYPES[self.kinds[name]]) for name in self.positions), PLACE])

    def flush_sync(self) -> None:
        """All rows inserted so far are visible when this returns."""
        self._hand_off()
        self._waiting.join()
        self._raise_failure()
        if self._query is not None:
            self._query.processAllAvailable()

    def stop(self) -> None:
        try:
            self.flush_sync()
        finally:
            if self._flusher is not None:
                self._waiting.put(None)
                self._flusher.join()
                self._flusher = None
            if self._query is not None:
                self._query.stop()
                self._query = None

    # --- counters

    @property
    def visible_rows(self) -> int:
        return self._visible

    @property
    def pending_rows(self) -> int:
        return self._inserted - self._arrived

    @property
    def batches_flushed(self) -> int:
        return self._flushed

    # --- reading

    def snapshot(self) -> Table:
        """The rows of the batches that have ended."""
        return Table(self._rows(self.spark, self._folders))

    def query(self, fn: Callable[[Table], R]) -> R:
        return fn(self.snapshot())

    def __enter__(self) -> StreamingTable:
        return self

    def __exit__(self, *_: object) -> None:
        self.stop()
