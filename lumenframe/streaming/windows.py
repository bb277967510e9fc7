"""Structured Streaming: windowed counts, sessions, repeats and hourly trends over an event stream.

Every function takes a streaming (or batch) DataFrame with an event-time column ts and declares its
watermark; rows later than that are dropped. to_table() drives a stream of files to its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK = "10 minutes"


def event_stream(spark: SparkSession, path: str, schema, files: int = 4) -> DataFrame:
    """A stream of the Parquet files of a folder, a few at a time, so that a backlog never comes at once.

    The last letter goes as a pattern: a table that is one file is then read like one that is a folder.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def tumbling(events: DataFrame, width: str, watermark: str = WATERMARK) -> DataFrame:
    """(start, event_type, n, total) of fixed windows."""
    out = _timed(events, watermark).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, slide: str, watermark: str = WATERMARK) -> DataFrame:
    """(start, event_type, n, total) of windows that overlap."""
    out = _timed(events, watermark).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, watermark: str = WATERMARK) -> DataFrame:
    """(user_id, start, end, n): a user's events with gaps under gap."""
    out = _timed(events, watermark).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_repeats(events: DataFrame, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    """Events whose keys were not seen within the watermark."""
    timed = _timed(events, watermark)
    return timed.dropDuplicatesWithinWatermark(keys) if timed.isStreaming else timed.dropDuplicates(keys)


def hourly_trend(events: DataFrame, item: str) -> DataFrame:
    """(hour, item, n): hourly counts kept for a day."""
    out = _timed(events, "24 hours").groupBy(F.window("ts", "1 hour"), item).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("hour"), item, "n")


def metric_alerts(events: DataFrame, threshold: float) -> DataFrame:
    """Events over a threshold: a stateless stream."""
    return events.where(F.col("value") > threshold)


def to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, and read what it gave out from an in-memory table.

    The table is on the driver, so this is for results of aggregations and for tests; to_parquet() is for the rest.
    """
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now into a Parquet folder, exactly once."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
