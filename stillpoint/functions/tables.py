"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of a narrow table, of a few numbers each, that share a file.
NARROW = 200_000
#: Intermediate tables are read by who wrote them, so nobody waits for a file that says they are whole.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: Least seconds between two calls for the driver's collector.
RELEASE_SECONDS = 15.0
_released = 0.0

#: Tables of the open ``scratch`` blocks of this thread, innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open scratch blocks", default=())


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none (unit tests) gets a temporary folder, which is
    recorded in the session; on a cluster the setting is required."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stillpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder through the Hadoop file system."""
    hpath, fs = _file_system(spark, path)
    fs.delete(hpath, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder through the Hadoop file system."""
    hpath, fs = _file_system(spark, path)
    if not fs.rename(hpath, _file_system(spark, to)[0]):
        raise OSError(f"cannot move {path} to {to}")


def point(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: readers see the old text or the new one."""
    fresh, fs = _file_system(spark, f"{path}.{uuid.uuid4().hex}")
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(fresh), fs.makeQualified(_file_system(spark, path)[0]), over)


def pointed(spark: SparkSession, path: str) -> str | None:
    """The text that ``point`` left at ``path``, if any."""
    hpath, fs = _file_system(spark, path)
    if not fs.exists(hpath):
        return None
    stream = fs.open(hpath)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    hpath, fs = _file_system(spark, path)
    return fs.exists(hpath)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` inside are deleted at the end, also after an error; a result that
    is to outlive them is ``kept``."""
    paths: list[str] = []
    outer = _OPEN.set((*_OPEN.get(), paths))
    try:
        yield
    finally:
        _OPEN.reset(outer)
        for path in paths:
            discard(spark, path)


def _write(df: DataFrame, tag: str, scope: int) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, tag)
    if len(blocks := _OPEN.get()) >= scope:
        blocks[-scope].append(path)
    df.write.options(**UNMARKED).parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of tables that are written by now. Spark does
    so once the driver has collected what refers to them, which a driver with memory to
    spare may put off for half an hour; a job of many tables asks for it, not more often
    than every few seconds."""
    global _released
    if time.monotonic() - _released > RELEASE_SECONDS:
        _released = time.monotonic()
        spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Give memory that this process has freed, but holds on to, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def returning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task's helper. A Python worker stays for later tasks, and what one task
    freed would stay with it: here the worker gives it back to the system."""
    try:
        yield from batches
    finally:
        del batches
        give_back()


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """A narrow table in as many files as its about ``rows`` rows fill, however many tasks make
    them. Each file and each task's folder costs its writer calls to the file system; the local
    one starts a process for each (chmod), which shares the executor's memory until it runs."""
    return df.repartition(max(1, -(-rows // NARROW)))


def together(df: DataFrame, rows: int | None) -> DataFrame:
    """A narrow stored table of about ``rows`` rows: read by one task if they fill one file at
    most. Joins and sums of such tables need no shuffle then; of larger ones, and of those with
    unknown ``rows``, they are shuffled."""
    return df if rows is None or rows > NARROW else df.coalesce(1)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut at a table
    that outlives any executor."""
    return _write(df, tag, 1)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """As ``written``, for the result of a ``scratch`` block: the table stays."""
    return _write(df, tag, 2)
