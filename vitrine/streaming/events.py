"""Streaming extension over the events table: windowed counts with late data, sessions, and batch search per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, folder: str, schema: T.StructType = EVENTS, name: str = "*.parquet") -> DataFrame:
    """The event files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and value per window and type; events later than ``late`` behind the newest are dropped in a stream."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = at.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return counted.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum")).select(F.col("w.start").alias("window_start"), "event_type", "events", "value_sum")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per user session; a session ends after ``gap`` without an event."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = at.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def run_to_memory(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there and return the in-memory result; for tests and smoke runs."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Answer every micro-batch of queries with a batch search; each batch lands once, in a folder by its number."""

    def answer(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
