"""Keyed tables: upserts, untouched buckets, broken writes, two writers, quarantine, run log, two sinks of one stream."""

import os

import pytest
from pyspark.sql import functions as F

from pitsight.sources import sinks
from pitsight.sources.keyed import ConcurrentWrite, Intake, KeyedTable, Written, tee

SCHEMA = "k long, v string, first_seen long"


def rows(spark, *values):
    return spark.createDataFrame(values, "k long, v string, first_seen long, seq int")


def content(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=repr)


def test_upserts_follow_the_order_of_arrival(spark, tmp_path):
    table = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=8)
    first = table.upsert(rows(spark, (1, "a", 10, 1), (1, "b", 20, 2), (2, None, 10, 1), (None, "n", 10, 1)), ["seq"], ["v"])
    assert first == Written(3, 0, 4)
    assert content(table) == sorted([(1, "b", 10), (2, None, 10), (None, "n", 10)], key=repr)
    second = table.upsert(rows(spark, (2, "c", 99, 2), (2, "d", 98, 1), (3, "e", 30, 1), (1, "b", 77, 1), (None, None, 1, 1)), ["seq"], ["v"])
    # Key 1 gets the value that it has: offered, not changed.
    assert second == Written(1, 2, 5)
    assert content(table) == sorted([(1, "b", 10), (2, "c", 10), (3, "e", 30), (None, None, 10)], key=repr)
    kept = table.upsert(rows(spark, (1, "zz", 0, 1), (4, "f", 40, 2), (4, "g", 41, 1)), ["seq"])
    assert kept == Written(1, 0, 3)
    assert (1, "b", 10) in content(table) and (4, "g", 41) in content(table)
    assert table.upsert(rows(spark), ["seq"]) == Written(0, 0, 0)
    assert sorted(r["k"] for r in table.lookup(spark.createDataFrame([(1,), (4,), (9,)], "k long")).collect()) == [1, 4]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=16)
    table.upsert(spark.range(400).select(F.col("id").alias("k"), F.lit("x").alias("v"), F.lit(0).cast("long").alias("first_seen"), F.lit(1).alias("seq")), ["seq"])
    before = table.manifest()["folders"]
    table.upsert(rows(spark, (5, "new", 1, 1)), ["seq"], ["v"])
    after = table.manifest()["folders"]
    assert sum(before[b] != after[b] for b in after) == 1 and len(after) == 16
    plan = table.lookup(spark.createDataFrame([(5,)], "k long"))
    assert len({f.rsplit("/", 1)[0] for f in plan.inputFiles()}) == 1
    assert content(table, 2) == sorted(((i, "x", 0) for i in range(400)), key=repr)


def test_a_broken_write_changes_nothing_and_two_writers_meet(spark, tmp_path, monkeypatch):
    table = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=4)
    table.upsert(rows(spark, (1, "a", 1, 1)), ["seq"])
    table.upsert(rows(spark, (1, "b", 1, 1)), ["seq"], ["v"])
    before, commit = content(table), KeyedTable._commit

    def lost(*_):
        raise OSError("driver lost")

    monkeypatch.setattr(KeyedTable, "_commit", lost)
    with pytest.raises(OSError):
        table.upsert(rows(spark, (1, "c", 1, 1), (2, "c", 1, 1)), ["seq"], ["v"])
    monkeypatch.setattr(KeyedTable, "_commit", commit)
    assert content(table) == before == [(1, "b", 1)]
    # Another writer is first: the second one's version is taken.
    version = table.version()
    monkeypatch.setattr(KeyedTable, "version", lambda self: version)
    table.upsert(rows(spark, (3, "mine", 1, 1)), ["seq"])
    with pytest.raises(ConcurrentWrite):
        table.upsert(rows(spark, (4, "theirs", 1, 1)), ["seq"])
    monkeypatch.undo()
    assert content(table) == [(1, "b", 1), (3, "mine", 1)]
    assert table.discard_unused() >= 1 and content(table) == [(1, "b", 1), (3, "mine", 1)]
    assert not [f for f in os.listdir(f"{tmp_path}/t/_manifests") if f.startswith(".") and not f.endswith(".crc")]


def test_tables_are_reopened_with_their_shape(spark, tmp_path):
    KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=4)
    again = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=99)
    assert again.buckets == 4 and content(again) == []
    with pytest.raises(ValueError):
        KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["v"])
    with pytest.raises(FileNotFoundError):
        KeyedTable.at(spark, f"{tmp_path}/none")


def run_of(number):
    return {"run_id": f"r{number}", "provider": "p", "resource_type": "team", "data_mode": "live", "batch": number}


def test_a_run_that_broke_off_between_tables_is_made_up_for(spark, tmp_path, monkeypatch):
    into = Intake.create(spark, f"{tmp_path}/i", SCHEMA, ["k"], buckets=4)
    batch = rows(spark, (1, "a", 1, 1), (2, "bad", 1, 1), (3, "c", 1, 1), (3, "bad", 1, 2))
    reason = F.when(F.col("v") == "bad", "bad_value")
    parents = (spark.createDataFrame([(1,), (2,)], "k long"), "k")
    original, calls = KeyedTable.upsert, []

    def failing(self, *args, **more):
        calls.append(self.path)
        if len(calls) == 2:
            raise OSError("quarantine lost")
        return original(self, *args, **more)

    monkeypatch.setattr(KeyedTable, "upsert", failing)
    with pytest.raises(OSError):
        into.run(batch, reason, run_of(1), ["seq"], ["v"], entity_id=F.col("k"), parents=parents)
    monkeypatch.undo()
    assert [(r["status"], r["error_summary"]) for r in into.runs.read().collect()] == [("failed", "OSError: quarantine lost")]
    for _ in range(2):
        log = into.run(batch, reason, run_of(1), ["seq"], ["v"], entity_id=F.col("k"), parents=parents)
        assert (log["status"], log["records_read"], log["records_accepted"], log["records_quarantined"]) == ("partial", 4, 1, 3)
    assert content(into.table) == [(1, "a", 1)]
    assert sorted((r["reason_code"], r["provider_entity_id"]) for r in into.quarantine.read().collect()) == [("bad_value", "2"), ("bad_value", "3"), ("missing_parent", "3")]
    assert [(r["status"], r["records_accepted"], r["error_summary"]) for r in into.runs.read().collect()] == [("partial", 1, None)]


def test_a_repeated_batch_adds_nothing_to_either_sink(spark, tmp_path):
    one, two = (KeyedTable.create(spark, f"{tmp_path}/{n}", SCHEMA, ["k"], buckets=4) for n in "ab")
    broken = [True]

    def second(batch_rows, batch):
        if broken:
            broken.pop()
            raise OSError("second sink lost")
        two.upsert(batch_rows, ["seq"], batch=batch)

    both = tee("w", lambda batch_rows, batch: one.upsert(batch_rows, ["seq"], ["v"], batch), second)
    batch = rows(spark, (1, "a", 1, 1))
    with pytest.raises(OSError):
        both(batch, 0)
    versions = one.version()
    assert content(one) == [(1, "a", 1)] and content(two) == []
    both(batch, 0)
    both(batch, 0)
    assert one.version() == versions and content(two) == [(1, "a", 1)]
    both(rows(spark, (2, "b", 1, 1)), 1)
    assert content(one) == content(two) == [(1, "a", 1), (2, "b", 1)]


def test_append_only_compares_values(spark, tmp_path):
    schema = "id long, a string, b string"
    moved = spark.createDataFrame([(1, None, "x"), (1, "x", None), (2, None, None), (2, None, None)], schema)
    assert sinks.append_only(moved, f"{tmp_path}/t", "id") == 1 and not os.path.exists(f"{tmp_path}/t")
    assert sinks.append_only(moved.where("a is null"), f"{tmp_path}/t", "id") == 0
    assert sinks.append_only(moved.where("id = 2 or a is not null"), f"{tmp_path}/t", "id") == 1
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").collect()), key=repr) == [(1, None, "x"), (2, None, None)]
