"""Structured Streaming over event files: windowed counters and removal of repeated events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowmill.sources.shared import shared_dir


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files in a folder; watermarks need times with a zone."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str | None = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and value sums by type and window; works on streams and tables alike. late: None where the events have a
    watermark already."""
    events = events.withWatermark("ts", late) if late else events
    grouped = events.groupBy(F.window("ts", width), "event_type")
    out = grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def unique_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Drops events whose id was seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for the files that are there, as a table in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/knowmill-{name}-{uuid.uuid4().hex}"
    running = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
