"""Incremental work: a folder of gold-ready raw files as a stream, and windows over events.

The window queries go beyond what the batch engine needs; they show the same tables as streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import gold


def ingest_stream(spark: SparkSession, source: str, schema, where: str, checkpoint: str) -> StreamingQuery:
    """Raw Parquet files that appear in `source` become gold rows, each file once.

    The checkpoint makes a file count once; a batch that is run again overwrites its own part.
    """

    def append(batch: DataFrame, number: int) -> None:
        new = gold.to_gold(batch).persist()
        n = new.count()
        marked = new
        if number and batches_before(number):
            # Only the hash columns of earlier canonical rows are read, and only those of this batch's contents are kept.
            marked = gold.mark_against(new, spark.read.parquet(where).filter(F.col("batch") < number), n)
        marked.drop("batch").write.mode("overwrite").parquet(f"{where}/batch={number}")
        new.unpersist()

    def batches_before(number: int) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(path) and any(int(f.getPath().getName().partition("=")[2] or number) < number for f in fs.listStatus(path))

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, length: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by tumbling window and type, with late rows dropped after the watermark."""
    at = F.col("ts").cast("timestamp")
    return (
        events.withColumn("at", at).withWatermark("at", lateness).groupBy(F.window("at", length), "event_type")
        .agg(F.count("*").alias("events"), F.sum("value").alias("value"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "value")
    )
