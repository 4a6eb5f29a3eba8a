"""The folder that all executors share, and files in it."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import SparkSession

#: Bytes that go to the JVM at once.
SLICE = 1 << 22
_own: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that isn't set, a temporary folder, but only of a session that runs in one process: on
    a cluster executors would not see it, so there it is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.TemporaryDirectory(prefix="tallyspark-"))
        atexit.register(_own[0].cleanup)
    return _own[0].name


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A new file on any store that Spark can write to."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, False)
    try:
        for i in range(0, len(data), SLICE):
            out.write(data[i : i + SLICE])
    finally:
        out.close()
