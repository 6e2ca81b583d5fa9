"""Streams with the meaning of the batch operators: deduplication, windows, latest state, availability."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema: str, per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream, so many a batch; times get a zone, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First arrivals of each key; keys are forgotten once the watermark has passed them by the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def windowed_totals(events: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; later events than the watermark allows are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    window = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy(window.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def running_latest(events: DataFrame) -> DataFrame:
    """For each user the last event by (ts, event_id) after every batch that changed it: state of three numbers a user."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (-1, -1, 0.0)
        for frame in frames:
            for t, event, value in zip(frame["us"], frame["event_id"], frame["value"]):
                best = max(best, (int(t), int(event), float(value)))
        state.update(best)
        yield pd.DataFrame([(key[0], *best)], columns=["user_id", "us", "event_id", "value"])

    rows = events.select("user_id", F.unix_micros("ts").alias("us"), "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, us long, event_id long, value double", "us long, event_id long, value double", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there, into Parquet, with its progress in the checkpoint folder."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
