"""Readers, sinks and streams over files in a temporary folder."""

import datetime as dt
import json

import pytest

from pitsight.sources import readers, sinks
from pitsight.streaming import streams

ROWS = "match_id long, event_at string, home_win int, draw int, away_win int, x double, version string, data_mode string"


def test_load_dataset_refuses_unsound_tables(spark, tmp_path):
    sound = [(2, "2024-01-02", 1, 0, 0, 1.0, "1", "live"), (1, "2024-01-01", 0, 1, 0, 2.0, "1", "live")]
    spark.createDataFrame(sound, ROWS).write.parquet(f"{tmp_path}/good")
    loaded = readers.load_dataset(spark, f"{tmp_path}/good", ["x"], {"version": "1"})
    assert [r["match_id"] for r in loaded.collect()] == [1, 2]
    bad = [*sound, (1, "2024-01-03", 1, 1, 0, None, "2", "mock")]
    spark.createDataFrame(bad, ROWS).write.parquet(f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="repeated"):
        readers.load_dataset(spark, f"{tmp_path}/bad", ["x"], {"version": "1"})
    with pytest.raises(ValueError, match="missing"):
        readers.load_dataset(spark, f"{tmp_path}/good", ["absent"])
    with pytest.raises(ValueError, match="label"):
        readers.load_prematch(spark, f"{tmp_path}/good")
    plan = readers.ids_in_window(spark, f"{tmp_path}/good", "2024-01-02", "2024-01-03")
    assert [r["match_id"] for r in plan.collect()] == [2]
    assert "PushedFilters: [IsNotNull(event_at)" in plan._jdf.queryExecution().toString()


def test_archives_and_events(spark, tmp_path):
    folder = tmp_path / "raw" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps({"id": "1", "request_key": "odds/historical/1"}))
    (folder / "b.json").write_text(json.dumps({"id": "2", "request_key": "odds/live"}))
    (folder / "c.json").write_text("{not json")
    archive = readers.read_archive(spark, str(tmp_path / "raw"), "id string, request_key string").cache()
    assert sorted(r["id"] for r in archive.collect()) == ["1", "2"]
    assert [r["request_key"] for r in readers.request_keys(archive).collect()] == ["odds/historical/1"]
    (tmp_path / "e.json").write_text(json.dumps({"data": [{"id": 1}, {"id": 2}]}))
    assert sorted(r["id"] for r in readers.read_events(spark, [str(tmp_path / "e.json")], "id: long").collect()) == [1, 2]


def test_raw_store_and_append_only(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    payloads = spark.createDataFrame([("p", at, "c1", "x", "live"), ("p", at, "c1", "x", "live"), ("p", at, "c2", "y", "live")], "provider string, collected_at timestamp, checksum string, body string, data_mode string")
    store = f"{tmp_path}/store"
    for _ in range(2):
        sinks.put_raw(payloads, store)
    assert spark.read.parquet(store).count() == 2
    rows, table = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string"), f"{tmp_path}/append"
    assert sinks.append_only(rows, table, "id") == 0 and sinks.append_only(rows, table, "id") == 0
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, "a"), (2, "b")]
    assert sinks.append_only(spark.createDataFrame([(2, "other"), (3, "c")], rows.schema), table, "id") == 1
    assert spark.read.parquet(table).count() == 2


def test_artefacts_registry_and_targets(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0)], "match_id long, x double")
    sinks.write_dataset(rows, rows.groupBy().count(), f"{tmp_path}/set")
    assert spark.read.parquet(f"{tmp_path}/set/parquet").collect() == rows.collect()
    assert spark.read.json(f"{tmp_path}/set/quality").first()["count"] == 1
    sinks.write_registry(spark, f"{tmp_path}/models", "elo", {"k": 20, "ha": 80})
    assert sinks.read_registry(spark, f"{tmp_path}/models", "elo") == {"k": 20.0, "ha": 80.0}
    at = dt.datetime(2024, 1, 1)
    odds = spark.createDataFrame([(1, 1, at), (2, 1, at + dt.timedelta(days=1)), (3, 9, at)], "snapshot_id long, match_id long, available_at timestamp_ntz")
    odds = odds.withColumn("kickoff_at", odds["available_at"])
    kept, left_out = sinks.target_scoped(odds, spark.createDataFrame([(1, at)], "match_id long, kickoff_at timestamp_ntz"))
    assert [r["snapshot_id"] for r in kept.collect()] == [1]
    assert {r["snapshot_id"]: r["reason"] for r in left_out.collect()} == {2: "after_kickoff", 3: "outside_universe"}


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_streams(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    first = [(i, at + dt.timedelta(minutes=10 * i), i % 3, "view", float(i), "{}") for i in range(60)]
    spark.createDataFrame([*first, *first[:5]], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.event_stream(spark, f"{tmp_path}/in", EVENTS)
    streams.run_available(streams.deduplicated(stream, ["event_id"]).select("event_id"), f"{tmp_path}/once", f"{tmp_path}/c1")
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/once").collect()) == list(range(60))
    streams.run_available(streams.windowed_totals(stream), f"{tmp_path}/totals", f"{tmp_path}/c2")
    totals = spark.read.parquet(f"{tmp_path}/totals").collect()
    assert all(r["n"] in (6, 11) for r in totals) and len(totals) >= 8
    query = streams.running_latest(stream).writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["user_id"]: r["event_id"] for r in spark.table("latest").collect()} == {0: 57, 1: 58, 2: 59}
    query = streams.sessions(stream, "15 minutes").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/c4").trigger(availableNow=True).start()
    query.awaitTermination()
    # One event every thirty minutes a user: every session holds one.
    assert all(r["n"] in (1, 2) for r in spark.table("sessions").collect())
