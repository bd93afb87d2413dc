"""Written intermediate tables and files in the folder the whole cluster shares."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
ROWS_PER_FILE = 500_000  #: of narrow tables


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one is made only where it is unset and all runs in one process (tests)."""
    named = spark.conf.get(_SETTING, None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{_SETTING} must name a folder that the whole cluster shares")
        named = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set(_SETTING, named)
    return named.rstrip("/")


def few(df: DataFrame, rows: int) -> DataFrame:
    """Narrow rows, about so many, in few partitions to be written.

    For every file and folder that a task writes, Hadoop without its native library starts a
    ``chmod`` beside the executor, whose memory is counted twice until that process is on its own.
    """
    return df.repartition(max(1, -(-rows // ROWS_PER_FILE)))


class Workspace:
    """A folder of one run for tables that cut lineage.

    A written table survives the loss of any executor, and its size is known to
    the planner, so that small ones are broadcast by the usual threshold only.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Free the shuffle files of what has been written: Spark removes them once the driver's JVM has collected their plans, which may else be long after."""
        gc.collect()
        for pause in (0.3, 0.0):  # the scheduler lets go of a job that has ended a moment later
            self.spark._jvm.System.gc()
            time.sleep(pause)


def file_system(uri: str):
    """(file system, path) for files that executors write and read themselves."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def write_atomically(uri: str, chunks) -> int:
    """Write the byte chunks under a name of this attempt, then move; returns the bytes written.

    A repeated or speculative task replaces the file with the same bytes.
    """
    system, path = file_system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.part"
    size = 0
    with system.open_output_stream(attempt, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(attempt, path)
    return size
