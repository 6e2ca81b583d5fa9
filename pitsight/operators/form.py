"""Rolling form, goals and head-to-head under strict visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds from kickoff until a result is known. A match sees results known strictly before its own kickoff.
DELAY = 3 * 3600
WINDOWS = (5, 10)
H2H_LEAST = 2


def _team_rows(matches: DataFrame) -> DataFrame:
    """One row for each match and side."""
    sides = F.explode(
        F.array(
            F.struct(F.lit("home").alias("side"), F.col("home_team_id").alias("team_id"), F.col("home_score").alias("gf"), F.col("away_score").alias("ga")),
            F.struct(F.lit("away").alias("side"), F.col("away_team_id").alias("team_id"), F.col("away_score").alias("gf"), F.col("home_score").alias("ga")),
        )
    )
    return matches.select("match_id", "status", F.unix_seconds(F.col("kickoff_at").cast("timestamp")).alias("kt"), sides.alias("x")).select("match_id", "status", "kt", "x.*")


def _points() -> Column:
    return F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)


def rolling_form(matches: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(match_id, side, team_id, played, points_k, goals_for_k, goals_against_k, available_k) for every match and side.

    Finished matches of a team are numbered by (kickoff, id), with running sums. How many of them a match may see is a
    count over a range frame that ends DELAY + 1 seconds before it; sums over the last k are then differences of the
    running sums at two numbers, fetched by equi-joins on (team, number). Cost is linear in the rows, frames hold no
    lists, and a team's rows are the unit of work.
    """
    rows = _team_rows(matches)
    finished = F.col("status") == "finished"
    seen = Window.partitionBy("team_id").orderBy("kt").rangeBetween(Window.unboundedPreceding, -(DELAY + 1))
    asked = rows.select("match_id", "side", "team_id", F.count(F.when(finished, 1)).over(seen).alias("played"))
    order = Window.partitionBy("team_id").orderBy("kt", "match_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.where(finished).select(
        "team_id",
        F.row_number().over(order).cast("long").alias("no"),
        F.sum(_points()).over(upto).alias("pts"),
        F.sum("gf").over(upto).alias("gf"),
        F.sum("ga").over(upto).alias("ga"),
    )

    def at(alias: str) -> DataFrame:
        return sums.select("team_id", *(F.col(c).alias(f"{c}_{alias}") for c in ("no", "pts", "gf", "ga")))

    out = asked
    for alias, k in (("now", 0), *((f"b{k}", k) for k in windows)):
        early = at(alias).withColumnRenamed("team_id", f"team_{alias}")
        out = out.join(early, (F.col("team_id") == F.col(f"team_{alias}")) & (F.col("played") - k == F.col(f"no_{alias}")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    columns = []
    for k in windows:
        for name, c in (("points", "pts"), ("goals_for", "gf"), ("goals_against", "ga")):
            columns.append((zero(f"{c}_now") - zero(f"{c}_b{k}")).cast("long").alias(f"{name}_{k}"))
        columns.append((F.col("played") >= k).cast("int").alias(f"available_{k}"))
    return out.select("match_id", "side", "team_id", "played", *columns)


def head_to_head(matches: DataFrame) -> DataFrame:
    """(match_id, meetings, home_wins, draws, away_wins, available): earlier meetings of the two teams, wins from the
    view of the present home side."""
    h, a = F.col("home_team_id"), F.col("away_team_id")
    kt = F.unix_seconds(F.col("kickoff_at").cast("timestamp"))
    w = Window.partitionBy("low", "high").orderBy("kt").rangeBetween(Window.unboundedPreceding, -(DELAY + 1))
    done = F.col("status") == "finished"
    winner = F.when(F.col("home_score") > F.col("away_score"), h).when(F.col("home_score") < F.col("away_score"), a)
    base = matches.select("match_id", "status", "home_team_id", F.least(h, a).alias("low"), F.greatest(h, a).alias("high"), kt.alias("kt"), winner.alias("winner"))
    count = lambda c: F.count(F.when(done & c, 1)).over(w)
    counted = base.select(
        "match_id", "home_team_id", "low",
        F.count(F.when(done, 1)).over(w).alias("meetings"), count(F.col("winner") == F.col("low")).alias("low_wins"),
        count(F.col("winner") == F.col("high")).alias("high_wins"), count(F.col("winner").isNull()).alias("draws"),
    )
    home_low = F.col("home_team_id") == F.col("low")
    return counted.select(
        "match_id", "meetings", F.when(home_low, F.col("low_wins")).otherwise(F.col("high_wins")).alias("home_wins"), "draws",
        F.when(home_low, F.col("high_wins")).otherwise(F.col("low_wins")).alias("away_wins"), (F.col("meetings") >= H2H_LEAST).cast("int").alias("available"),
    )
