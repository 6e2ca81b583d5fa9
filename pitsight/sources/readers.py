"""Reads with checks: feature tables, point lookups, raw archives, windows, seasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ("target", "home_win", "draw", "away_win")


def dataset_problems(rows: DataFrame, required: list[str], versions: dict[str, str] | None = None) -> DataFrame:
    """One row of counts, all zero for a sound feature table: repeated ids, nulls in required columns, rows of another
    version or that aren't live, and one-hot targets that don't sum to one. One aggregation over the table."""
    missing = [c for c in [*required, *LABELS[1:]] if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    some_null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in required))
    other = reduce(lambda a, b: a | b, (~F.col(k).eqNullSafe(F.lit(v)) for k, v in (versions or {}).items()), F.lit(False))
    not_live = ~F.col("data_mode").eqNullSafe(F.lit("live")) if "data_mode" in rows.columns else F.lit(False)
    return rows.agg(
        (F.count("match_id") - F.countDistinct("match_id")).alias("repeated"), F.count_if(some_null).alias("nulls"), F.count_if(other).alias("other_version"),
        F.count_if(not_live).alias("not_live"), F.count_if(F.coalesce(F.col("home_win") + F.col("draw") + F.col("away_win") != 1, F.lit(True))).alias("not_one_hot"),
    )


def load_dataset(spark: SparkSession, path: str, required: list[str], versions: dict[str, str] | None = None) -> DataFrame:
    """A checked feature table in (event_at, match_id) order; a table with problems is refused with their counts."""
    rows = spark.read.parquet(path)
    found = dataset_problems(rows, required, versions).first().asDict()
    if any(found.values()):
        raise ValueError(f"unsound dataset: {found}")
    return rows.orderBy("event_at", "match_id")


def ids_in_window(spark: SparkSession, path: str, start: str, end: str, at: str = "event_at") -> DataFrame:
    """Distinct match ids of a half-open window; two columns are read and the window reaches the scan."""
    return spark.read.parquet(path).where((F.col(at) >= start) & (F.col(at) < end)).select("match_id").distinct().orderBy("match_id")


def load_prematch(spark: SparkSession, path: str) -> DataFrame:
    """Unlabelled features; a file that has label columns is refused."""
    rows = spark.read.parquet(path)
    labels = [c for c in LABELS if c in rows.columns]
    if labels:
        raise ValueError(f"label columns in a prematch file: {labels}")
    return rows


def overlaid(history: DataFrame, overlay: DataFrame, key: str = "match_id") -> DataFrame:
    """History, and what only the overlay has."""
    return history.unionByName(overlay.join(history.select(key), key, "left_anti").select(*history.columns))


def read_archive(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All JSON documents below a folder with a fixed schema; files that can't be read as such are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", "true").json(root)
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def request_keys(archive: DataFrame, pattern: str = "%historical%") -> DataFrame:
    return archive.where(F.col("request_key").like(pattern)).select("request_key").distinct()


def read_events(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The data arrays of JSON files, one row an element."""
    return spark.read.schema(f"data array<struct<{schema}>>").option("multiLine", "true").json(paths).select(F.explode("data").alias("e")).select("e.*")


def season_selection(seasons: DataFrame, ids: list[int] | None = None, start: str | None = None, end: str | None = None, latest: int = 3) -> DataFrame:
    """Seasons by id, else by overlap with a date range (open ends allowed), else each competition's latest ones."""
    if ids:
        return seasons.where(F.col("season_id").isin(ids))
    if start or end:
        low, high = F.lit(start or "0001-01-01").cast("date"), F.lit(end or "9999-12-31").cast("date")
        return seasons.where((F.coalesce("starting_at", low) <= high) & (F.coalesce("ending_at", high) >= low))
    from pyspark.sql import Window

    w = Window.partitionBy("competition").orderBy(F.desc("ending_at"), "season_id")
    return seasons.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= latest).drop("_r")


def history_of(snapshots: DataFrame, ids: DataFrame, market: str | None = None) -> DataFrame:
    """Snapshots of the given matches, as a semi-join of two tables whatever their sizes."""
    rows = snapshots.where(F.col("market") == market) if market else snapshots
    return rows.join(ids.select("match_id").distinct(), "match_id", "left_semi")
