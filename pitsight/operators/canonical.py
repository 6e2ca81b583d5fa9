"""The canonical tables assembled: selections under snapshots under matches, with the names that the keys stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested(matches: DataFrame, snapshots: DataFrame, selections: DataFrame) -> DataFrame:
    """matches with snapshots: array of (available_at, snapshot_id, bookmaker, selections), selections: array of
    (selection, decimal_odds), both in that order. Snapshots without selections are dropped, matches without snapshots
    have an empty array, selections without a snapshot and snapshots without a match go unseen.

    Two shuffles whatever the depth: selections meet their snapshots by snapshot_id, and are then placed by match_id,
    which both the grouping by snapshot and that by match go on to use; matches are placed alike."""
    picked = selections.select("snapshot_id", F.struct("selection", "decimal_odds").alias("s"))
    met = snapshots.select("snapshot_id", "match_id", "bookmaker", "available_at").join(picked, "snapshot_id")
    by_snapshot = met.repartition("match_id").groupBy("match_id", "snapshot_id").agg(F.sort_array(F.collect_list("s")).alias("selections"), F.first("bookmaker").alias("bookmaker"), F.first("available_at").alias("available_at"))
    by_match = by_snapshot.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("available_at", "snapshot_id", "bookmaker", "selections"))).alias("snapshots"))
    kind = by_match.schema["snapshots"].dataType
    return matches.join(by_match, "match_id", "left").withColumn("snapshots", F.coalesce("snapshots", F.array().cast(kind)))


def canonical(sports: DataFrame, leagues: DataFrame, teams: DataFrame, matches: DataFrame, snapshots: DataFrame, selections: DataFrame) -> DataFrame:
    """nested() with the sport's code and the names of league and teams, null where a key has no row. The dimension tables
    are joined as their sizes allow."""
    out = nested(matches, snapshots, selections)
    out = out.join(leagues.select("league_id", "sport_id", F.col("name").alias("league")), "league_id", "left").join(sports.select("sport_id", F.col("code").alias("sport")), "sport_id", "left")
    for side in ("home", "away"):
        out = out.join(teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("team_name").alias(f"{side}_team")), f"{side}_team_id", "left")
    return out
