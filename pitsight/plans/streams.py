"""Streams run over a whole table and their results, against batch SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from ..streaming import streams
from .registry import query

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, compose: Callable[[SparkSession, str], DataFrame], options: dict[str, str] | None = None) -> DataFrame:
    """Rows that a provider or writer would have delivered: composed from the tables once a session, then read back.
    options: further ones of the Parquet writer."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _STORED:
        folder = new_folder(spark)
        compose(spark, sf_dir).write.options(**{"compression": "zstd"} | (options or {})).parquet(folder)
        _STORED[key] = folder
    return spark.read.parquet(_STORED[key])


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = new_folder(spark)
    streams.run_available(stream, f"{folder}/out", f"{folder}/progress")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events offered twice, each taken once."""
    events = streams.event_stream(spark, f"{sf_dir}/events.parque[t]", SCHEMA)
    once = streams.deduplicated(events.unionByName(events), ["event_id"])
    return _run(spark, once.select("event_id", "user_id", "event_type", "value"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly totals of the windows that the watermark has closed."""
    events = streams.event_stream(spark, f"{sf_dir}/events.parque[t]", SCHEMA)
    totals = _run(spark, streams.windowed_totals(events))
    return totals.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))
