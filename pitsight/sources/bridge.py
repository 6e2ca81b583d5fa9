"""Domain tables as views of the star schema: matches, odds snapshots, teams and events.

An order is a match, its line items are the odds snapshots of bookmakers, and the numbers of returned and accepted
items are the scores. Only integer arithmetic and divisions by 100 are used, so every engine gets the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEAMS = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a match: keys, kickoff, status, scores (null unless finished) and when the result is available."""
    goals = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(
        F.count_if(F.col("l_returnflag") == "A").cast("int").alias("h"), F.count_if(F.col("l_returnflag") == "R").cast("int").alias("a")
    )
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("match_id"),
        F.col("o_orderdate").alias("kickoff_at"),
        (F.col("o_custkey") % TEAMS).alias("home_team_id"),
        ((F.col("o_custkey") % TEAMS + 1 + F.col("o_orderkey") % 19) % TEAMS).alias("away_team_id"),
        F.col("o_orderpriority").alias("league"),
        F.year("o_orderdate").alias("season"),
        F.when(F.col("o_orderstatus") == "P", "scheduled").otherwise("finished").alias("status"),
    )
    done = F.col("status") == "finished"
    return orders.join(goals, "match_id").select(
        *orders.columns,
        F.when(done, F.col("h")).alias("home_score"),
        F.when(done, F.col("a")).alias("away_score"),
        F.when(done, F.col("kickoff_at") + F.expr("INTERVAL 3 HOURS")).alias("available_at"),
    )


def odds(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """One row an odds snapshot; away odds are null where the market is incomplete."""
    of = of if of is not None else matches(spark, sf_dir)
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    age = (line * 6 - 6 - F.when(supp % 5 == 0, 12).otherwise(0)).cast("int")
    return (
        items.join(of.select("match_id", "kickoff_at"), F.col("l_orderkey") == F.col("match_id"))
        .select(
            (F.col("l_orderkey") * 1_000_000_000 + part * 10_000 + supp * 10 + line).alias("snapshot_id"),
            "match_id",
            "kickoff_at",
            (supp % 7).alias("bookmaker"),
            age.alias("age_h"),
            ((F.lit(105) + part % 400) / 100e0).alias("home_odds"),
            ((F.lit(205) + supp % 300) / 100e0).alias("draw_odds"),
            F.when(part % 10 != 0, (F.lit(105) + (part * 7 + supp) % 500) / 100e0).alias("away_odds"),
        )
        .withColumn("available_at", F.col("kickoff_at") - F.make_dt_interval(F.lit(0), F.col("age_h")))
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").where(F.col("n_nationkey") < TEAMS)
    return nation.select(F.col("n_nationkey").cast("long").alias("team_id"), F.initcap(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("team_name"), F.col("n_regionkey").cast("long").alias("region_id"))


def predictions(of: DataFrame) -> DataFrame:
    """Probabilities for matches from a rating difference that the team numbers stand in for."""
    from ..functions.odds import elo_1x2

    home, draw, away = elo_1x2((F.col("home_team_id") - F.col("away_team_id")) * 15e0)
    return of.select("match_id", home.alias("p_home"), draw.alias("p_draw"), away.alias("p_away"))
