"""Writes: dataset artefacts, a content-addressed raw store, append-only tables, a model registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_dataset(rows: DataFrame, quality: DataFrame, folder: str) -> None:
    """A dataset as Parquet and JSON, and its quality report as JSON."""
    rows.write.mode("overwrite").parquet(f"{folder}/parquet")
    rows.write.mode("overwrite").json(f"{folder}/json")
    quality.write.mode("overwrite").json(f"{folder}/quality")


def put_raw(payloads: DataFrame, path: str) -> None:
    """Appends payloads (provider, collected_at, checksum, body, data_mode) that the store doesn't hold yet, in folders
    by mode, provider and day; what is there is never written again. Repeats within the batch go in once."""
    spark = payloads.sparkSession
    fresh = payloads.dropDuplicates(["provider", "checksum"])
    if _exists(spark, path):
        stored = spark.read.parquet(path).select("provider", "checksum")
        fresh = fresh.join(stored, ["provider", "checksum"], "left_anti")
    dated = fresh.withColumn("day", F.to_date("collected_at"))
    dated.write.mode("append").partitionBy("data_mode", "provider", "day").parquet(path)


def append_only(rows: DataFrame, path: str, key: str) -> int:
    """Appends rows with new keys; rows that repeat a stored one are passed over. Returns the number of keys that stand
    for another payload; then nothing is written. Payloads are compared by their values, nulls being values."""
    spark = rows.sparkSession
    columns = sorted(c for c in rows.columns if c != key)
    payload = F.struct(*columns).alias("_payload")
    offered = rows.select(key, payload)
    if not _exists(spark, path):
        count = _conflicts(offered, key)
        if not count:
            rows.dropDuplicates([key]).write.parquet(path)
        return count
    stored = spark.read.parquet(path)
    count = _conflicts(offered.union(stored.select(key, payload)), key)
    if not count:
        rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti").write.mode("append").parquet(path)
    return count


def _conflicts(rows: DataFrame, key: str) -> int:
    """Keys with more than one payload. A struct is never null, so that one of nulls only counts like any other."""
    return rows.groupBy(key).agg(F.countDistinct("_payload").alias("n")).where("n > 1").count()


def target_scoped(odds: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Odds of the wanted matches up to kickoff, and those left out with the reason."""
    joined = odds.drop("kickoff_at").join(universe.select("match_id", "kickoff_at"), "match_id", "left")
    reason = F.when(F.col("kickoff_at").isNull(), "outside_universe").when(F.col("available_at") > F.col("kickoff_at"), "after_kickoff")
    tagged = joined.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def write_registry(spark: SparkSession, path: str, name: str, parameters: dict[str, float]) -> None:
    """A model's parameters as rows of a table: no pickles."""
    rows = spark.createDataFrame([(name, k, float(v)) for k, v in sorted(parameters.items())], "model string, parameter string, value double")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/model={name}")


def read_registry(spark: SparkSession, path: str, name: str) -> dict[str, float]:
    return {r["parameter"]: r["value"] for r in spark.read.parquet(f"{path}/model={name}").select("parameter", "value").collect()}


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
