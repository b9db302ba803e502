"""Streams of fetches: the same extraction as in batch, exactly once by a checkpoint and idempotent batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from webloom.operators.extract import extract


def fetch_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Each ``fetch_id`` once; the state forgets ids ``late`` after their ``fetched_at``."""
    return stream.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["fetch_id"])


def windowed_status(stream: DataFrame, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Fetches by window of ``fetched_at`` and status; a window comes out once the watermark has passed it."""
    counts = deduplicated(stream, late).groupBy(F.window("fetched_at", window).alias("w"), "fetch_status").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "fetch_status", "n")


def write_pages(stream: DataFrame, output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Extract the 90 columns of each fetch into Parquet, a folder a batch; a batch that runs again overwrites its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        extract(rows, ("fetch_id",)).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
