"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    base = f"file://{tempfile.mkdtemp(prefix='tabulark-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Tables written once and read again, so a lost executor never costs a recomputation.

    Paths end with the JVM; ``drop`` frees one earlier, when nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tabulark-{what}-{uuid.uuid4().hex}"
        path, fs = _path(spark, self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = _path(self.spark, self.path(name))
            fs.delete(path, True)

    def release_shuffles(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished steps."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
