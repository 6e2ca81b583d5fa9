"""Fetch slots, coverage of odds, observed events and identity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import asof, identity, intake, slots
from ..sources import bridge
from .intake import EVENTS, KEYS, SLUG, keyed
from .registry import query

TARGETS = """, tg AS (SELECT m.league, CAST(m.kickoff_at AS DATE) AS day, m.match_id, m.match_id % 40 = 0 AS requested, coalesce(k.n, 0) > 0 AS covered, m.home_team_id % 9 = 0 AS excluded
  FROM m LEFT JOIN (SELECT match_id, count(*) AS n FROM s WHERE available_at <= kickoff_at AND bookmaker < 2 GROUP BY match_id) k ON k.match_id = m.match_id)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    had = bridge.odds(spark, sf_dir, m).where("available_at <= kickoff_at AND bookmaker < 2").select("match_id").distinct().withColumn("had", F.lit(True))
    joined = m.join(had, "match_id", "left")
    return joined.select("league", F.to_date("kickoff_at").alias("day"), "match_id", (F.col("match_id") % 40 == 0).alias("requested"), F.coalesce("had", F.lit(False)).alias("covered"), (F.col("home_team_id") % 9 == 0).alias("excluded"))


@query(TARGETS + """ SELECT league, day, count(*) AS n, CASE WHEN bool_or(requested) THEN 'requested' WHEN bool_and(covered) THEN 'covered' WHEN bool_and(covered OR excluded) THEN 'identity_only' ELSE 'fetch' END AS state FROM tg GROUP BY league, day""")
def slot_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.partition(targets(spark, sf_dir), ["league", "day"])


@query("""SELECT league, slot_s, previous FROM (SELECT league, slot_s, lag(slot_s) OVER (PARTITION BY league ORDER BY slot_s) AS previous FROM (SELECT DISTINCT league, CAST(epoch(kickoff_at) AS BIGINT) AS slot_s FROM m)) WHERE slot_s - previous < 172800""")
def slot_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots less than two days after the one before."""
    at = bridge.matches(spark, sf_dir).select("league", F.unix_seconds(F.col("kickoff_at").cast("timestamp")).alias("slot_s")).distinct()
    return slots.gap_violations(at, "league", "slot_s", 172_800)


@query("""SELECT league, day, spent FROM (SELECT *, max(CAST(spent > 300 AS INT)) OVER (PARTITION BY league ORDER BY day ROWS UNBOUNDED PRECEDING) AS over_ FROM (
  SELECT league, day, CAST(sum(cost) OVER (PARTITION BY league ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM (SELECT league, CAST(kickoff_at AS DATE) AS day, 10 * count(*) AS cost FROM m GROUP BY 1, 2))) WHERE over_ = 0""")
def slot_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots by day until a league's budget would be passed."""
    days = bridge.matches(spark, sf_dir).groupBy("league", F.to_date("kickoff_at").alias("day")).agg((F.count(F.lit(1)) * 10).alias("cost"))
    return slots.within_budget(days, "league", ["day"], "cost", 300).select("league", "day", "spent")


MATRIX = """, cm AS (SELECT m.match_id, league, coalesce(b, 0) AS n_before, coalesce(a, 0) AS n_after, last_age_h, CASE WHEN home_team_id = 13 THEN 'excluded_identity' WHEN coalesce(a, 0) + coalesce(b, 0) = 0 THEN 'no_snapshot' WHEN coalesce(b, 0) = 0 THEN 'none_by_kickoff'
  WHEN last_age_h IS NULL THEN 'incomplete_market' WHEN last_age_h > 24 THEN 'stale' END AS reason FROM m LEFT JOIN (
    SELECT match_id, count(*) FILTER (WHERE available_at <= kickoff_at) AS b, count(*) FILTER (WHERE available_at > kickoff_at) AS a, min(age_h) FILTER (WHERE available_at <= kickoff_at AND away_odds IS NOT NULL) AS last_age_h
    FROM s WHERE bookmaker < 3 GROUP BY match_id) k ON k.match_id = m.match_id)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    return slots.coverage_matrix(m, bridge.odds(spark, sf_dir, m).where("bookmaker < 3"), m.where("home_team_id = 13"))


@query(MATRIX + " SELECT * FROM cm")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir)


@query(MATRIX + " SELECT league, coalesce(reason, 'usable') AS reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY league), 6) AS share FROM cm GROUP BY league, coalesce(reason, 'usable')")
def coverage_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = matrix(spark, sf_dir).groupBy("league", F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("league")), 6))


@query("""SELECT event_id, user_id, value, in_window FROM (SELECT *, ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03' AS in_window, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def observed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last arrival under each key, with a mark for a window."""
    e = bridge.read(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return slots.observed(e, "key", ["ts", "event_id"], "ts", "2024-01-02", "2024-01-03").select("event_id", "user_id", "value", "in_window")


@query("""SELECT user_id, count(*) AS visible, round(sum(value), 4) AS total FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN ts + to_hours(CAST(event_id % 5 AS INT)) END AS event_at, TIMESTAMP '2024-01-05 00:00:00' + to_hours(CAST(user_id % 48 AS INT)) AS cutoff_at FROM events)
WHERE ts < cutoff_at AND (event_at IS NULL OR event_at < cutoff_at) GROUP BY user_id""")
def visible_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that each key may see strictly before its cutoff."""
    e = bridge.read(spark, sf_dir, "events")
    facts = e.select("user_id", "value", F.col("ts").alias("available_at"), F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 5).cast("int"))).alias("event_at"))
    cutoffs = e.select("user_id").distinct().withColumn("cutoff_at", F.lit("2024-01-05").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("user_id") % 48).cast("int")))
    return asof.visible_before(facts, cutoffs, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("visible"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT coalesce(label, 'outside') AS label, count(*) AS n FROM (SELECT CASE WHEN kickoff_at >= TIMESTAMP '1996-01-01' AND kickoff_at < TIMESTAMP '1996-07-01' THEN 'w1' WHEN kickoff_at >= TIMESTAMP '1996-07-01' AND kickoff_at < TIMESTAMP '1997-02-01' THEN 'w2' WHEN kickoff_at >= TIMESTAMP '1998-01-01' AND kickoff_at < TIMESTAMP '1999-01-01' THEN 'w3' END AS label FROM m) GROUP BY 1""")
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by half-open window: a handful of bounds, sent to all tasks."""
    bounds = spark.createDataFrame([("w1", "1996-01-01", "1996-07-01"), ("w2", "1996-07-01", "1997-02-01"), ("w3", "1998-01-01", "1999-01-01")], "label string, a string, b string")
    bounds = bounds.select("label", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    m = bridge.matches(spark, sf_dir)
    joined = m.join(F.broadcast(bounds), (F.col("kickoff_at") >= F.col("a")) & (F.col("kickoff_at") < F.col("b")), "left")
    return joined.groupBy(F.coalesce("label", F.lit("outside")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT provider, entity_type, provider_entity_id, count(DISTINCT canonical_id) AS n_ids FROM (
  SELECT 'p' || (c_nationkey % 3) AS provider, c_mktsegment AS entity_type, c_custkey % 100 AS provider_entity_id, c_nationkey % 4 AS canonical_id FROM customer) GROUP BY ALL HAVING count(DISTINCT canonical_id) > 1""")
def binding_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bridge.read(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("p"), (F.col("c_nationkey") % 3).cast("string")).alias("provider"), F.col("c_mktsegment").alias("entity_type"), (F.col("c_custkey") % 100).alias("provider_entity_id"), (F.col("c_nationkey") % 4).alias("canonical_id"))
    return identity.binding_conflicts(rows)


ALIASES = ", aa AS (SELECT 'a' || (s_suppkey % 37) AS alias, CASE WHEN s_suppkey % 11 = 0 THEN 'a' || (s_suppkey % 37) ELSE 'n' || (s_suppkey % 5) END AS name FROM supplier)"


@query(ALIASES + """, ab AS (SELECT alias, count(*) AS n, count(DISTINCT name) AS names, count(*) FILTER (WHERE alias = name) AS own FROM aa GROUP BY alias)
SELECT 'repeated' AS problem, alias, n FROM ab WHERE n > names UNION ALL SELECT 'ambiguous', alias, n FROM ab WHERE names > 1 UNION ALL SELECT 'identity', alias, n FROM ab WHERE own > 0""")
def alias_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    alias = F.concat(F.lit("a"), (k % 37).cast("string"))
    rows = bridge.read(spark, sf_dir, "supplier").select(alias.alias("alias"), F.when(k % 11 == 0, alias).otherwise(F.concat(F.lit("n"), (k % 5).cast("string"))).alias("name"))
    return identity.alias_problems(rows)


@query("SELECT match_id, CASE WHEN home_team_id % 4 = 1 THEN home_team_id + 1000 ELSE home_team_id END AS home_team_id, CASE WHEN away_team_id % 4 = 1 THEN away_team_id + 1000 ELSE away_team_id END AS away_team_id FROM m")
def rewritten_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir).select("match_id", "home_team_id", "away_team_id")
    t = bridge.teams(spark, sf_dir).where("team_id % 4 = 1")
    return identity.rewritten(m, t.select(F.col("team_id").alias("old_id"), (F.col("team_id") + 1000).alias("new_id")), ["home_team_id", "away_team_id"])


@query(KEYS + ", kb AS (SELECT key, match_id, 0 AS place FROM ky UNION ALL SELECT replace(key, 'nation', 'land'), match_id, 1 FROM ky UNION ALL SELECT rev, match_id, 2 FROM ky) SELECT key, match_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place, match_id) AS r FROM kb) WHERE r = 1")
def rebuilt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key that a match can be found under, bound to the first that has it."""
    offers = F.array(
        F.struct(F.col("key"), F.lit(0).alias("place")), F.struct(F.replace("key", F.lit("nation"), F.lit("land")).alias("key"), F.lit(1).alias("place")), F.struct(X.reversed_key(F.col("key")).alias("key"), F.lit(2).alias("place"))
    )
    keys = keyed(spark, sf_dir).select("match_id", F.explode(offers).alias("o")).select("match_id", "o.key", "o.place").where(F.col("key").isNotNull())
    return identity.key_bindings(keys)


@query("""SELECT count(*) AS events, count(*) FILTER (WHERE x OR a) AS matched, count(*) FILTER (WHERE NOT (x OR a)) AS rejected, count(*) FILTER (WHERE x) AS by_exact, count(*) FILTER (WHERE a AND NOT x) AS by_alias FROM (
  SELECT bool_or(k = 0) AS x, bool_or(k = 1) AS a FROM (SELECT match_id // 3 AS event_id, match_id % 7 AS k FROM m) GROUP BY event_id)""")
def identity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("match_id") % 7
    rows = bridge.matches(spark, sf_dir).select(F.floor(F.col("match_id") / 3).alias("event_id"), F.when(k == 0, "exact").when(k == 1, "alias").otherwise("unmatched").alias("status"))
    return identity.identity_statistics(rows)


@query(EVENTS + " SELECT match_id, home_team, away_team FROM pe WHERE " + SLUG.format(x="home_team") + " LIKE '%nation-1%' OR " + SLUG.format(x="away_team") + " LIKE '%nation-1%'")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches whose sides' names hold a text, whatever the case and accents."""
    m, t = bridge.matches(spark, sf_dir), bridge.teams(spark, sf_dir)
    named = m.join(t.select(F.col("team_id").alias("home_team_id"), F.col("team_name").alias("home_team")), "home_team_id").join(t.select(F.col("team_id").alias("away_team_id"), F.col("team_name").alias("away_team")), "away_team_id")
    has = lambda c: F.contains(X.slugify(F.col(c)), F.lit("nation-1"))
    return named.where(has("home_team") | has("away_team")).select("match_id", "home_team", "away_team")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type HAVING count(DISTINCT CAST(value * 100 AS BIGINT) % 3) > 1")
def payload_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under which an append-only store would be offered different payloads."""
    e = bridge.read(spark, sf_dir, "events").withColumn("payload", F.try_mod(F.round(F.col("value") * 100).cast("long"), F.lit(3)))
    bad = intake.conflicts(e, ["user_id", "event_type"], ["payload"]).select("user_id", "event_type")
    return e.join(bad, ["user_id", "event_type"], "left_semi").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
