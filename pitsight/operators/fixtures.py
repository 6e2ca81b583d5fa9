"""Provider fixtures: nested JSON into canonical match rows, with a reason for each row that can't be taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intake import STATE_CODES, preferred_score, status_of

FIXTURE_SCHEMA = (
    "id long, league_id long, season_id long, state_id int, starting_at string, placeholder boolean, "
    "participants array<struct<id: long, name: string, meta: struct<location: string>>>, "
    "scores array<struct<description: string, participant: string, goals: int>>, venue struct<name: string>"
)
PAYLOAD_SCHEMA = "payload_id long, games array<struct<id: long, home: string, away: string, starts: string, home_points: int, away_points: int>>"


def participant(side: str) -> Column:
    return F.try_element_at(F.filter("participants", lambda p: p["meta"]["location"] == side), F.lit(1))


def lenient_time(value: Column) -> Column:
    """A provider's time: epoch seconds as digits, or a date and time with or without T and zone; without one it is UTC."""
    seconds = F.when(value.rlike(r"^\d{9,11}$"), F.timestamp_seconds(value.try_cast("long")))
    return F.coalesce(seconds, F.try_to_timestamp(F.regexp_replace(value, "T", " "))).cast("timestamp_ntz")


def normalised(fixtures: DataFrame) -> DataFrame:
    """(match_id, league_id, season_id, kickoff_at, status, home_team_id, away_team_id, home_score, away_score, reason):
    one row a fixture; reason names the first thing that keeps it from being taken, null if nothing does."""
    home, away = participant("home"), participant("away")
    status = status_of(F.col("state_id"), STATE_CODES)
    scores = [preferred_score(F.col("scores"), side) for side in ("home", "away")]
    done = status == "finished"
    reason = (
        F.when(F.col("placeholder"), "placeholder").when(status.isNull(), "unknown_status").when(lenient_time(F.col("starting_at")).isNull(), "bad_time")
        .when(home.isNull() | away.isNull(), "missing_participant").when(done & (scores[0].isNull() | scores[1].isNull()), "missing_score")
    )
    return fixtures.select(
        F.col("id").alias("match_id"), "league_id", "season_id", lenient_time(F.col("starting_at")).alias("kickoff_at"), status.alias("status"), home["id"].alias("home_team_id"), away["id"].alias("away_team_id"),
        F.when(done, scores[0]).alias("home_score"), F.when(done, scores[1]).alias("away_score"), reason.alias("reason"),
    )


def whole_payloads(payloads: DataFrame) -> DataFrame:
    """(payload_id, game_id, home, away, reason): the games of payloads of which one bad game fails all."""
    games = payloads.select("payload_id", F.explode("games").alias("g")).select("payload_id", F.col("g.id").alias("game_id"), "g.home", "g.away", F.col("g.home_points").alias("home_points"), F.col("g.away_points").alias("away_points"))
    bad = F.col("home").isNull() | F.col("away").isNull() | (F.coalesce(F.col("home_points"), F.lit(0)) < 0) | (F.coalesce(F.col("away_points"), F.lit(0)) < 0)
    failed = F.count_if(bad).over(Window.partitionBy("payload_id")) > 0
    return games.select("payload_id", "game_id", "home", "away", F.when(failed, "payload_failed").alias("reason"))
