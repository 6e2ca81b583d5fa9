"""Catalog reads, as-of odds and value picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import odds as O
from ..operators import asof, value
from ..sources import bridge
from .registry import query

R = 6


def r(c, digits: int = R):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


@query("""
SELECT match_id, kickoff_at, league, season, h.team_name AS home_team, a.team_name AS away_team, r_name AS home_region, home_score, away_score, status
FROM m JOIN t h ON h.team_id = home_team_id JOIN t a ON a.team_id = away_team_id JOIN region ON r_regionkey = h.region_id""")
def catalog_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their teams' and region's names: small dimensions, joined as their statistics allow."""
    m, t = bridge.matches(spark, sf_dir), bridge.teams(spark, sf_dir)
    regions = bridge.read(spark, sf_dir, "region")
    home = t.select(F.col("team_id").alias("home_team_id"), F.col("team_name").alias("home_team"), "region_id")
    away = t.select(F.col("team_id").alias("away_team_id"), F.col("team_name").alias("away_team"))
    joined = m.join(home, "home_team_id").join(away, "away_team_id").join(regions, F.col("region_id") == F.col("r_regionkey"))
    return joined.select("match_id", "kickoff_at", "league", "season", "home_team", "away_team", F.col("r_name").alias("home_region"), "home_score", "away_score", "status")


@query("SELECT team_id, team_name, region_id FROM t WHERE team_name ILIKE '%nation 1%' ORDER BY team_name, team_id")
def catalog_team_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.teams(spark, sf_dir).where(F.col("team_name").ilike("%nation 1%")).orderBy("team_name", "team_id")


@query("""
SELECT match_id, kickoff_at, league, home_team_id, away_team_id FROM m
WHERE status = 'finished' AND kickoff_at >= TIMESTAMP '1997-03-01' AND kickoff_at < TIMESTAMP '1997-03-08' AND (home_team_id = 7 OR away_team_id = 7)""")
def catalog_match_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    day = (F.col("kickoff_at") >= F.lit("1997-03-01").cast("timestamp_ntz")) & (F.col("kickoff_at") < F.lit("1997-03-08").cast("timestamp_ntz"))
    return m.where(day & (F.col("status") == "finished") & ((F.col("home_team_id") == 7) | (F.col("away_team_id") == 7))).select("match_id", "kickoff_at", "league", "home_team_id", "away_team_id")


@query("SELECT match_id, kickoff_at, league FROM m ORDER BY kickoff_at DESC, match_id DESC LIMIT 8")
def newest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.matches(spark, sf_dir).orderBy(F.desc("kickoff_at"), F.desc("match_id")).limit(8).select("match_id", "kickoff_at", "league")


@query("SELECT match_id, kickoff_at, count(*) OVER () AS total FROM m WHERE league = '1-URGENT' ORDER BY kickoff_at, match_id LIMIT 20 OFFSET 40")
def match_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with the total: the total is its own aggregate, the page a top-k."""
    m = bridge.matches(spark, sf_dir).where("league = '1-URGENT'").select("match_id", "kickoff_at")
    return m.orderBy("kickoff_at", "match_id").offset(40).limit(20).crossJoin(F.broadcast(m.agg(F.count(F.lit(1)).alias("total"))))


@query("SELECT match_id, snapshot_id, bookmaker, available_at, home_odds, draw_odds, away_odds FROM lo")
def asof_odds_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = asof.latest_odds(bridge.odds(spark, sf_dir))
    return last.select("match_id", "snapshot_id", "bookmaker", "available_at", "home_odds", "draw_odds", "away_odds")


@query("""
SELECT match_id, snapshot_id, available_at, away_odds FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY available_at DESC, snapshot_id DESC) AS r FROM s WHERE available_at < kickoff_at) WHERE r = 1""")
def asof_odds_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = asof.latest_odds(bridge.odds(spark, sf_dir), inclusive=False, complete_only=False)
    return last.select("match_id", "snapshot_id", "available_at", "away_odds")


@query("""
SELECT match_id, CASE WHEN c > 0 THEN 'ok' WHEN e > 0 THEN 'incomplete' WHEN n > 0 THEN 'future_only' ELSE 'unavailable' END AS status, n AS n_snapshots, e AS n_eligible
FROM (SELECT m.match_id, count(snapshot_id) AS n, count(*) FILTER (WHERE s.available_at <= s.kickoff_at) AS e,
        count(*) FILTER (WHERE s.available_at <= s.kickoff_at AND away_odds IS NOT NULL) AS c FROM m LEFT JOIN s ON s.match_id = m.match_id GROUP BY m.match_id)""")
def odds_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    return asof.odds_status(m, bridge.odds(spark, sf_dir, m))


@query("""
SELECT m.match_id, count(snapshot_id) AS n, min(s.available_at) AS first_at, max(s.available_at) AS last_at,
  count(*) FILTER (WHERE s.available_at <= s.kickoff_at) AS n_by_kickoff FROM m LEFT JOIN s ON s.match_id = m.match_id GROUP BY m.match_id""")
def snapshot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    return asof.snapshot_states(m, bridge.odds(spark, sf_dir, m))


@query("""
SELECT snapshot_id, selection, odds FROM (
  SELECT snapshot_id, unnest(['HOME', 'DRAW', 'AWAY']) AS selection, unnest([home_odds, draw_odds, away_odds]) AS odds FROM s) WHERE odds IS NOT NULL""")
def odds_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = bridge.odds(spark, sf_dir).select("snapshot_id", F.col("home_odds").alias("HOME"), F.col("draw_odds").alias("DRAW"), F.col("away_odds").alias("AWAY"))
    return wide.unpivot("snapshot_id", ["HOME", "DRAW", "AWAY"], "selection", "odds").where(F.col("odds").isNotNull())


@query("SELECT snapshot_id, home_odds, draw_odds, away_odds FROM s")
def odds_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections back to one row a snapshot: conditional maxima, so that no list of values has to be looked up first."""
    long = odds_unpivot(spark, sf_dir)
    pick = lambda s: F.max(F.when(F.col("selection") == s, F.col("odds"))).alias(f"{s.lower()}_odds")
    return long.groupBy("snapshot_id").agg(pick("HOME"), pick("DRAW"), pick("AWAY"))


VALUES = """, v AS (
  SELECT *, p_sel - 1e0 / odds AS edge, p_sel * odds - 1e0 AS ev, 1e0 / odds AS implied FROM (
    SELECT match_id, snapshot_id, kickoff_at, age_h, overround, unnest(['HOME', 'DRAW', 'AWAY']) AS selection, unnest([home_odds, draw_odds, away_odds]) AS odds,
      unnest([nh, nd, 1e0 - nh - nd]) AS no_vig, unnest([p_home, p_draw, p_away]) AS p_sel
    FROM (SELECT *, 1e0 / home_odds / overround AS nh, 1e0 / draw_odds / overround AS nd
      FROM (SELECT *, 1e0 / home_odds + 1e0 / draw_odds + 1e0 / away_odds AS overround FROM lo JOIN p USING (match_id))))),
g AS (SELECT *, CASE WHEN reason IS NULL THEN ev + edge END AS score, CASE WHEN age_h * 2 <= 24 THEN 2 ELSE 1 END AS freshness FROM (
  SELECT *, CASE WHEN age_h > 24 THEN 'stale_odds' WHEN p_sel < 0 THEN 'below_minimum_model_probability' WHEN ev < 0 THEN 'negative_ev' WHEN edge < 0 THEN 'negative_edge' END AS reason FROM v))"""


def values(spark: SparkSession, sf_dir: str, m: DataFrame | None = None) -> DataFrame:
    m = m if m is not None else bridge.matches(spark, sf_dir)
    return value.value_rows(asof.latest_odds(bridge.odds(spark, sf_dir, m)), bridge.predictions(m))


@query(VALUES + """
SELECT match_id, selection, odds, round(implied, 6) AS implied, round(no_vig, 6) AS no_vig, round(overround, 6) AS overround, round(p_sel, 6) AS p, round(edge, 6) AS edge, round(ev, 6) AS ev FROM v""")
def value_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).select("match_id", "selection", "odds", *(r(c).alias(c) for c in ("implied", "no_vig", "overround", "p", "edge", "ev")))


@query(VALUES + """
SELECT match_id, selection, odds, round(p_sel, 6) AS p, round(score, 6) AS score, freshness, row_number() OVER (ORDER BY score DESC, ev DESC, edge DESC, freshness DESC, match_id, selection) AS pick_rank
FROM g WHERE reason IS NULL QUALIFY pick_rank <= 500""")
def value_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: as-of odds, value, gates, global ranking, first 500."""
    eligible = value.gated(values(spark, sf_dir)).where(F.col("reason").isNull())
    return value.top_picks(eligible, 500).select("match_id", "selection", "odds", r("p").alias("p"), r("score").alias("score"), "freshness", "pick_rank")


@query(VALUES + """
SELECT match_id, selection, round(score, 6) AS score, row_number() OVER (PARTITION BY match_id ORDER BY score DESC, ev DESC, edge DESC, freshness DESC, selection) AS match_rank FROM g WHERE reason IS NULL""")
def picks_within_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = value.gated(values(spark, sf_dir)).where(F.col("reason").isNull())
    return value.ranked(eligible, ["match_id"], "match_rank").select("match_id", "selection", r("score").alias("score"), "match_rank")


@query(VALUES + "SELECT reason, count(*) AS n FROM g WHERE reason IS NOT NULL GROUP BY reason")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value.gated(values(spark, sf_dir)).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(VALUES + "SELECT n_picks, count(*) AS n_matches FROM (SELECT m.match_id, count(g.selection) AS n_picks FROM m LEFT JOIN g ON g.match_id = m.match_id AND reason IS NULL GROUP BY m.match_id) GROUP BY n_picks")
def picks_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    picks = value.gated(values(spark, sf_dir, m)).where(F.col("reason").isNull()).groupBy("match_id").agg(F.count(F.lit(1)).alias("k"))
    return m.select("match_id").join(picks, "match_id", "left").groupBy(F.coalesce("k", F.lit(0)).alias("n_picks")).agg(F.count(F.lit(1)).alias("n_matches"))


@query(VALUES + """
SELECT match_id, selection, round(edge, 6) AS edge FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY CASE WHEN edge = 0 THEN -1 ELSE edge END DESC, selection) AS r FROM v)
WHERE r = 1 ORDER BY CASE WHEN edge = 0 THEN -1 ELSE edge END DESC, match_id LIMIT 8""")
def best_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best selection of each match by edge, then the eight best; an edge of exactly zero counts as -1."""
    v = values(spark, sf_dir).withColumn("key", F.when(F.col("edge") == 0, F.lit(-1e0)).otherwise(F.col("edge")))
    best = v.groupBy("match_id").agg(F.min_by(F.struct("selection", "edge", "key"), F.struct(-F.col("key"), "selection")).alias("b")).select("match_id", "b.*")
    return best.orderBy(F.desc("key"), "match_id").limit(8).select("match_id", "selection", r("edge").alias("edge"))


@query(VALUES + """, pv AS (SELECT odds, p_sel, implied + CASE WHEN match_id % 40 = 0 THEN 1e-6 ELSE 0e0 END AS implied, edge - CASE WHEN match_id % 41 = 0 THEN 1e-6 ELSE 0e0 END AS edge,
  ev + CASE WHEN match_id % 43 = 0 THEN 1e-6 WHEN match_id % 43 = 1 THEN 1e-12 ELSE 0e0 END AS ev FROM v)
SELECT count(*) AS n, count(*) FILTER (WHERE abs(implied - 1e0 / odds) > 1e-9) AS implied_errors, count(*) FILTER (WHERE abs(edge - (p_sel - 1e0 / odds)) > 1e-9) AS edge_errors,
  count(*) FILTER (WHERE abs(ev - (p_sel * odds - 1)) > 1e-9) AS ev_errors FROM pv""")
def value_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published figures with planted faults, one kind below the tolerance, against recomputed ones."""
    k = F.col("match_id")
    off = lambda n, by: F.when(k % n == 0, by).otherwise(0e0)
    published = values(spark, sf_dir).withColumns({"implied": F.col("implied") + off(40, 1e-6), "edge": F.col("edge") - off(41, 1e-6), "ev": F.col("ev") + F.when(k % 43 == 1, 1e-12).otherwise(off(43, 1e-6))})
    return value.parity_errors(published)


@query("""
SELECT s.match_id, s.snapshot_id, s.bookmaker, round(p_home * s.home_odds - 1e0, 6) AS ev_home, round(p_draw * s.draw_odds - 1e0, 6) AS ev_draw, round(p_away * s.away_odds - 1e0, 6) AS ev_away,
  (lo.snapshot_id IS NOT NULL) AS selected
FROM s JOIN p ON p.match_id = s.match_id LEFT JOIN lo ON lo.snapshot_id = s.snapshot_id AND lo.match_id = s.match_id WHERE s.available_at <= s.kickoff_at AND s.away_odds IS NOT NULL""")
def bookmaker_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected value against every eligible complete snapshot, with a mark on the one that the as-of rule selects."""
    m = bridge.matches(spark, sf_dir)
    eligible = bridge.odds(spark, sf_dir, m).where((F.col("available_at") <= F.col("kickoff_at")) & asof.complete_market()).join(bridge.predictions(m), "match_id")
    # The selected snapshot is the last in each match's window, found with the match's rows already together.
    last = F.max(F.struct("available_at", "snapshot_id")).over(Window.partitionBy("match_id"))
    marked = eligible.withColumn("selected", last["snapshot_id"] == F.col("snapshot_id"))
    ev = lambda s: r(O.expected_value(F.col(f"p_{s}"), F.col(f"{s}_odds"))).alias(f"ev_{s}")
    return marked.select("match_id", "snapshot_id", "bookmaker", ev("home"), ev("draw"), ev("away"), "selected")
