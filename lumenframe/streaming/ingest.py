"""Streaming ingestion: new metadata files become media texts, and windowed counts of detections.

The batch operators do the work; a stream only decides when. Late rows are bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sparse import postings
from ..sources.files import grouped_media


def metadata_stream(spark: SparkSession, root: str) -> DataFrame:
    """``path, raw`` of JSON files as they come."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def ingest_postings(stream: DataFrame, table_path: str, checkpoint: str):
    """Append the postings of every batch of new files to a Parquet table; a batch that is tried again replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        postings(grouped_media(batch)).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``window, entity, n`` of ``events(ts, entity)``, for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "entity").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "entity", "n")
