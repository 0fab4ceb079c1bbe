"""Intermediate tables in the folder that all executors share.

A table is written as Parquet, which cuts the lineage and survives lost executors;
the shuffle files that its making left behind go at once, and so does memory that the
driver has freed but not given back. Tables go by name when their owner says so, and
what is left goes when the driver ends.
"""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one is set only where it is unset in a local run."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/burrow-checkpoints"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go when the query that made them ends."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, the path as it knows it, and the JVM."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at, jvm


def remove(spark: SparkSession, path: str) -> bool:
    fs, at, _ = file_system(spark, path)
    return fs.delete(at, True)


def give_back(spark: SparkSession) -> None:
    """Hands memory that the driver has freed back to the system.

    The C library keeps it otherwise: in the JVM what its compiler works with, hundreds of MB after some thousand plans, and in
    Python what a fit worked on. Where there is no such library or command, nothing happens.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:  # by the interface, as the server's own class is closed to reflection
        kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.java.lang.Class.forName(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Py4JError:
        pass


class Tables:
    """Tables of one job, each in a folder of its own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/burrow-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.clear)

    def add(self, df: DataFrame, *by: str) -> DataFrame:
        """The rows as written, partitioned by the given columns."""
        path = f"{self.folder}/{self._n}"
        self._n += 1
        with freeing_shuffles(self.spark):
            df.write.partitionBy(*by).parquet(path)
        give_back(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out = out.select(*(f"`{c}`" for c in df.columns)) if by else out
        out._burrow_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for table in tables:
            remove(self.spark, table._burrow_path)

    def clear(self) -> None:
        atexit.unregister(self.clear)
        try:
            remove(self.spark, self.folder)
        except Exception:  # noqa: BLE001 the session may have ended
            pass
