"""StreamingTable: what a batch costs, back-pressure, failures, and rows from both ways in."""

import threading
import time

import pytest

from tallyspark import StreamingTable
from tallyspark.streaming import table as streaming

KINDS = {"k": "dict", "n": "int"}


def total(table):
    return int(table.query(lambda t: t.sum("n").values[0]))


def until(test, seconds=30):
    end = time.monotonic() + seconds
    while not test():
        assert time.monotonic() < end
        time.sleep(0.02)


def test_a_batch_starts_no_job(spark, tmp_path):
    """The time of many small batches was that of a write, a micro-batch and a count for each."""
    n = streaming.MERGE - 1
    jobs = []
    with StreamingTable(KINDS, 2, queue_capacity=1, spark=spark, path=str(tmp_path)) as table:
        spark.sparkContext.setJobGroup("inserts", "")
        try:
            table.insert_all(f"a\t{i}" for i in range(2 * n))
            table.flush_sync()
            jobs += spark.sparkContext.statusTracker().getJobIdsForGroup("inserts")
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert jobs == [] and table._query is None
        assert (table.visible_rows, table.pending_rows, table.batches_flushed) == (2 * n, 0, n)
        assert total(table) == sum(range(2 * n))


def test_many_batches_with_back_pressure(spark, tmp_path):
    """Several rounds of merges, with the last batch not full; the order of first appearance is that of the inserts."""
    m, rows = streaming.MERGE, streaming.MERGE**2 + 3
    with StreamingTable(KINDS, 1, queue_capacity=1, spark=spark, path=str(tmp_path)) as table:
        table.insert_all(f"k{i // m}\t{i}" for i in range(rows))
        table.flush_sync()
        assert (table.visible_rows, table.pending_rows, table.batches_flushed) == (rows, 0, rows)
        assert [level for level, _ in table._folders] == [2, 0, 0, 0]
        assert total(table) == sum(range(rows))
        assert table.query(lambda t: int(t.where("k", "<", "k3").count().values[0])) == 3 * m
        places = [r[0] for r in table.snapshot().df.orderBy(streaming.ROW).select("n").collect()]
        assert places == list(range(rows))


def test_insert_blocks_while_the_queue_is_full(spark, tmp_path, monkeypatch):
    go, publish = threading.Event(), StreamingTable._publish
    monkeypatch.setattr(StreamingTable, "_publish", lambda self, *a: (go.wait(60), publish(self, *a)))
    with StreamingTable(KINDS, 1, queue_capacity=2, spark=spark, path=str(tmp_path)) as table:
        producer = threading.Thread(target=table.insert_all, args=([f"a\t{i}" for i in range(8)],))
        producer.start()
        until(lambda: table._waiting.full() and table._inserted == 4)  # one is being flushed, two wait, one is handed off
        time.sleep(0.3)
        assert producer.is_alive() and (table._inserted, table.visible_rows, table.pending_rows) == (4, 0, 4)
        go.set()
        producer.join(60)
        table.flush_sync()
        assert not producer.is_alive() and (table.visible_rows, table.batches_flushed) == (8, 8) and total(table) == sum(range(8))


def test_a_failed_flush_is_told(spark, tmp_path, monkeypatch):
    def fails(*_):
        raise OSError("no space")

    monkeypatch.setattr(StreamingTable, "_publish", fails)
    table = StreamingTable(KINDS, 1, queue_capacity=1, spark=spark, path=str(tmp_path))
    with pytest.raises(RuntimeError):
        table.insert_all(f"a\t{i}" for i in range(50))
    with pytest.raises(RuntimeError):
        table.flush_sync()
    with pytest.raises(RuntimeError):
        table.stop()
    assert table._flusher is None and table.visible_rows == 0


def test_rows_that_hold_line_ends(spark, tmp_path):
    """One row each, as inserted; they were cut into several before, and pending_rows fell below 0."""
    with StreamingTable({"n": "int", "k": "dict"}, 3, spark=spark, path=str(tmp_path)) as table:
        table.insert_all(["1\ta\nb", "", "2\tc\r", "3\té ", "4"])
        table.flush_sync()
        assert (table.visible_rows, table.pending_rows, table.batches_flushed) == (5, 0, 2)
        found = [tuple(r) for r in table.snapshot().df.orderBy(streaming.ROW).select("n", "k").collect()]
        assert found == [(1, "a\nb"), (0, ""), (2, "c"), (3, "é "), (4, "")]


def test_rows_of_the_source_folder_and_inserted_ones(spark, tmp_path):
    with StreamingTable(KINDS, 2, spark=spark, path=str(tmp_path)) as table:
        table.insert_all(["a\t1", "b\t2", "c\t4"])
        spark.createDataFrame([("a\t8",), ("d\t16",)], "value string").coalesce(1).write.text(f"{table.root}/source")
        table._start()
        table.flush_sync()
        assert (table.visible_rows, table.pending_rows, table.batches_flushed) == (5, 0, 3) and total(table) == 31
        table.insert_all(f"e\t{32 * (i % 2)}" for i in range(2 * streaming.MERGE))
        table.stop()
        assert total(table) == 31 + 32 * streaming.MERGE and len(table._folders) < streaming.MERGE


def test_inserted_events_start_jobs_by_merge_not_by_batch(spark):
    """stream_insert with batches of 20 rows: jobs that read, merge and count, and none for each of 50 batches."""
    from tallyspark import catalog

    spark.sparkContext.setJobGroup("events", "")
    try:
        found = catalog.inserted(spark, "/root/testdata/sf0.001", 20, 256).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("events")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r)[:3] for r in found] == [(1000, 0, 50)]
    assert len(jobs) < 20


def test_inserted_events_start_a_job_for_many_batches(spark):
    """500 batches of two rows: parsed 256 at a time; a merge to Parquet for each 16 were 32 jobs."""
    from tallyspark import catalog

    spark.sparkContext.setJobGroup("many", "")
    try:
        found = catalog.inserted(spark, "/root/testdata/sf0.001", 2, 256).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("many")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    clicks = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type = 'click'").count()
    assert [tuple(r) for r in found] == [(1000, 0, 500, clicks)]
    assert len(jobs) < 10


def test_a_batch_writes_no_file(spark, tmp_path):
    """One for each 16 batches, and one for the rest when a query comes; the same query again writes none."""
    files = lambda: {p.name for p in tmp_path.rglob("inserted/*.parquet")}
    n = streaming.MERGE
    with StreamingTable(KINDS, 2, spark=spark, path=str(tmp_path)) as table:
        table.insert_all(f"a\t{i}" for i in range(4 * n + 6))
        table.flush_sync()
        assert len(files()) == 2 and [level for level, _ in table._folders] == [1, 1, 0, 0, 0]
        assert total(table) == total(table) == sum(range(4 * n + 6)) and len(files()) == 3
        table.insert_all(["b\t1", "b\t2"])
        table.flush_sync()
        assert total(table) == sum(range(4 * n + 6)) + 3 and len(files()) == 4
        assert table.query(lambda t: int(t.filter(k="b").sum("n").values[0])) == 3


def test_lines_on_the_driver_keep_their_order(spark):
    """In blocks of any size, with line ends, nothing and no value in them."""
    from tallyspark import catalog

    texts = [None if i % 7 == 0 else "" if i % 7 == 1 else f"é\n{i}\t" for i in range(2500)]
    lines = spark.createDataFrame([(t,) for t in texts], "value string").repartition(1).sortWithinPartitions("value").cache()
    want = [r["value"] for r in lines.collect()]
    assert sorted(map(str, want)) == sorted(map(str, texts))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        assert list(catalog.on_the_driver(lines)) == want
        assert list(catalog.on_the_driver(lines.limit(0))) == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        lines.unpersist()
