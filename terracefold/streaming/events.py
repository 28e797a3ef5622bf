"""Streams of events (event_id, ts, user_id, event_type, value): windows, sessions, deduplication, snapshot appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums per window and type; rows later than the watermark are dropped from state by design of the feature."""
    w = F.window("ts", width)
    out = _marked(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


def sliding(events: DataFrame, width: str = "2 days", every: str = "1 day", late: str = "1 day") -> DataFrame:
    out = _marked(events, late).groupBy(F.window("ts", width, every).alias("w")).agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("start"), "events")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    out = _marked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    return _marked(events, late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def _marked(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def append_snapshots(stream: DataFrame, store: str, checkpoint: str):
    """Append each batch as a revision named by its number; a batch that comes again replaces itself, so retries add nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/revision={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
