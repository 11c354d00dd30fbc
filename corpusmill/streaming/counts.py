"""Structured Streaming over event files: windowed counts with a watermark, each run of a query going on from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.tables import place as place


def hourly(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """hour, event_type, events: tumbling counts of a stream (or a table) with ts and event_type."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", delay)
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("hour"), "event_type", "events")


def ingested(spark: SparkSession, pattern: str, out: str) -> DataFrame:
    """Counts of all event files that fit a path pattern, taken as a stream until none is left. Another run
    with the same out goes on from its checkpoint and takes new files only. Updates of each micro-batch are written under
    its own number, so that a repeated batch replaces itself; the last update of a window holds."""
    schema = spark.read.parquet(pattern).schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    stream = hourly(spark.readStream.schema(schema).parquet(pattern))
    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("hour timestamp, event_type string, events long, batch long").parquet(f"{out}/rows")
    return rows.groupBy("hour", "event_type").agg(F.max_by("events", "batch").alias("events"))
