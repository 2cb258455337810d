"""Places for derived tables that all executors can reach."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, removed when the JVM ends; local sessions may use a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = f"file://{tempfile.mkdtemp(prefix='tabulark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    where = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def _file(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, where: str, content: bytes) -> None:
    """A small file in any store that Spark writes."""
    path, fs = _file(spark, where)
    out = fs.create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


class _Output(io.RawIOBase):
    """An output stream of a store as a file to write."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, b) -> int:
        self.out.write(bytearray(b))
        return len(b)

    def close(self) -> None:
        if not self.closed:
            self.out.close()
        super().close()


def open_output(spark: SparkSession, where: str) -> io.BufferedWriter:
    """A new file in any store that Spark writes, to be written from front to end."""
    path, fs = _file(spark, where)
    return io.BufferedWriter(_Output(fs.create(path, True)), 1 << 20)


def write_text(spark: SparkSession, where: str, text: str | None) -> None:
    """A small text file; None removes it."""
    if text is None:
        path, fs = _file(spark, where)
        fs.delete(path, False)
    else:
        write_bytes(spark, where, text.encode())


def read_text(spark: SparkSession, where: str) -> str | None:
    """The text of a small file, None if it isn't there."""
    path, fs = _file(spark, where)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
    finally:
        stream.close()


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def separate_projections(spark: SparkSession):
    """Imports parse dozens of columns at once, more than one generated method holds; apart, each projection is compiled."""
    return _setting(spark, "spark.sql.codegen.wholeStage", "false")


def shuffles_removed(spark: SparkSession):
    """Each query's shuffle files are removed when it ends, not when the driver happens to collect its garbage; for frames that run once."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
