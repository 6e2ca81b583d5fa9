"""Form, head-to-head, ratings, the feature table and its rejections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import odds as O
from ..operators import elo, form, metrics
from ..session import written
from ..sources import bridge
from .registry import query

FORM = """, sides AS (
  SELECT match_id, 'home' AS side, home_team_id AS team_id, status, CAST(epoch(kickoff_at) AS BIGINT) AS kt, home_score AS gf, away_score AS ga FROM m
  UNION ALL SELECT match_id, 'away', away_team_id, status, CAST(epoch(kickoff_at) AS BIGINT), away_score, home_score FROM m),
done AS (
  SELECT team_id, kt, row_number() OVER w AS no, sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) OVER w AS pts, sum(gf) OVER w AS gf, sum(ga) OVER w AS ga
  FROM sides WHERE status = 'finished' WINDOW w AS (PARTITION BY team_id ORDER BY kt, match_id ROWS UNBOUNDED PRECEDING)),
asked AS (
  SELECT match_id, side, team_id, count(*) FILTER (WHERE status = 'finished') OVER (PARTITION BY team_id ORDER BY kt RANGE BETWEEN UNBOUNDED PRECEDING AND 10801 PRECEDING) AS played FROM sides),
form AS (
  SELECT a.match_id, a.side, a.team_id, a.played,
    CAST(coalesce(n.pts, 0) - coalesce(b5.pts, 0) AS BIGINT) AS points_5, CAST(coalesce(n.gf, 0) - coalesce(b5.gf, 0) AS BIGINT) AS goals_for_5,
    CAST(coalesce(n.ga, 0) - coalesce(b5.ga, 0) AS BIGINT) AS goals_against_5, CAST(a.played >= 5 AS INT) AS available_5,
    CAST(coalesce(n.pts, 0) - coalesce(b10.pts, 0) AS BIGINT) AS points_10, CAST(coalesce(n.gf, 0) - coalesce(b10.gf, 0) AS BIGINT) AS goals_for_10,
    CAST(coalesce(n.ga, 0) - coalesce(b10.ga, 0) AS BIGINT) AS goals_against_10, CAST(a.played >= 10 AS INT) AS available_10
  FROM asked a LEFT JOIN done n ON n.team_id = a.team_id AND n.no = a.played LEFT JOIN done b5 ON b5.team_id = a.team_id AND b5.no = a.played - 5
  LEFT JOIN done b10 ON b10.team_id = a.team_id AND b10.no = a.played - 10)"""
H2H = """, pairs AS (
  SELECT match_id, home_team_id AS h, least(home_team_id, away_team_id) AS lo, greatest(home_team_id, away_team_id) AS hi, status, CAST(epoch(kickoff_at) AS BIGINT) AS kt,
    CASE WHEN home_score > away_score THEN home_team_id WHEN home_score < away_score THEN away_team_id END AS winner FROM m),
hh AS (
  SELECT match_id, h, lo, count(*) FILTER (WHERE status = 'finished') OVER w AS meetings, count(*) FILTER (WHERE status = 'finished' AND winner = lo) OVER w AS lw,
    count(*) FILTER (WHERE status = 'finished' AND winner = hi) OVER w AS hw, count(*) FILTER (WHERE status = 'finished' AND winner IS NULL) OVER w AS draws
  FROM pairs WINDOW w AS (PARTITION BY lo, hi ORDER BY kt RANGE BETWEEN UNBOUNDED PRECEDING AND 10801 PRECEDING)),
h2h AS (
  SELECT match_id, meetings, CASE WHEN h = lo THEN lw ELSE hw END AS home_wins, draws, CASE WHEN h = lo THEN hw ELSE lw END AS away_wins, CAST(meetings >= 2 AS INT) AS available FROM hh)"""
ELO = """, ev AS MATERIALIZED (
  SELECT league, match_id, h, a, kind, hs, aw, row_number() OVER (ORDER BY ts, kind, match_id) AS n FROM (
    SELECT league, match_id, home_team_id AS h, away_team_id AS a, 0 AS kind, epoch(kickoff_at) AS ts, 0 AS hs, 0 AS aw FROM m
    UNION ALL SELECT league, match_id, home_team_id, away_team_id, 1, epoch(available_at), home_score, away_score FROM m WHERE status = 'finished')),
cell AS (SELECT * FROM (VALUES {cells}) c(k, ha)),
w AS (
  SELECT k, ha, CAST('' AS VARCHAR) AS league, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS match_id, 1 AS kind, [1500e0 FOR x IN range(20)] AS r, 0e0 AS he, 0e0 AS ae FROM cell
  UNION ALL
  SELECT k, ha, league, n, match_id, kind, CASE WHEN kind = 0 THEN r ELSE [CASE WHEN x = h THEN he + k * (act - e) WHEN x = a THEN ae + k * ((1e0 - act) - (1e0 - e)) ELSE r[x + 1] END FOR x IN range(20)] END, he, ae
  FROM (SELECT w.k, w.ha, ev.league, ev.n, ev.match_id, ev.kind, ev.h, ev.a, w.r, w.r[ev.h + 1] AS he, w.r[ev.a + 1] AS ae,
          1e0 / (1e0 + pow(10e0, (w.r[ev.a + 1] - (w.r[ev.h + 1] + w.ha)) / 400e0)) AS e, CASE WHEN hs > aw THEN 1e0 WHEN hs = aw THEN 0.5e0 ELSE 0e0 END AS act
        FROM w JOIN ev ON ev.n = w.n + 1)),
elo AS (SELECT k, ha, league, match_id, he AS home_elo, ae AS away_elo, he - ae AS elo_diff FROM w WHERE kind = 0)"""
KS, ADVANTAGES = (10, 15, 20, 25, 30), (0, 40, 60, 80, 100)
ELO_GRID = ELO.replace("{cells}", ", ".join(f"({k}e0, {ha}e0)" for k in KS for ha in ADVANTAGES))
ELO = ELO.replace("{cells}", "(20e0, 80e0)")


@query(FORM + " SELECT * FROM form")
def rolling_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.rolling_form(bridge.matches(spark, sf_dir))


@query(H2H + " SELECT * FROM h2h")
def h2h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.head_to_head(bridge.matches(spark, sf_dir))


@query(ELO + " SELECT league, match_id, round(home_elo, 6) AS home_elo, round(away_elo, 6) AS away_elo, round(elo_diff, 6) AS elo_diff FROM elo")
def elo_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    walked = elo.elo_walk(m).join(m.select("match_id", "league"), "match_id")
    return walked.select("league", "match_id", *(F.round(c, 6).alias(c) for c in ("home_elo", "away_elo", "elo_diff")))


FEATURES = FORM + H2H + ELO + """, feats AS (
  SELECT m.match_id, m.kickoff_at, m.league, CASE WHEN home_score > away_score THEN 'HOME' WHEN home_score < away_score THEN 'AWAY' WHEN home_score = away_score THEN 'DRAW' END AS target,
    home_elo AS home_elo_pre, away_elo AS away_elo_pre, elo_diff, 1 AS elo_available,
    h.points_5 AS home_form_5, a.points_5 AS away_form_5, h.available_5 AS home_form_5_available, a.available_5 AS away_form_5_available,
    h.points_10 AS home_form_10, a.points_10 AS away_form_10, h.available_10 AS home_form_10_available, a.available_10 AS away_form_10_available,
    h.goals_for_5 AS home_goals_for_5, h.goals_against_5 AS home_goals_against_5, a.goals_for_5 AS away_goals_for_5, a.goals_against_5 AS away_goals_against_5,
    h.goals_for_10 AS home_goals_for_10, h.goals_against_10 AS home_goals_against_10, a.goals_for_10 AS away_goals_for_10, a.goals_against_10 AS away_goals_against_10,
    x.home_wins AS h2h_home_wins, x.draws AS h2h_draws, x.away_wins AS h2h_away_wins, x.available AS h2h_available, x.meetings AS h2h_matches, h.played AS home_matches_played, a.played AS away_matches_played, m.status
  FROM m JOIN elo ON elo.match_id = m.match_id JOIN form h ON h.match_id = m.match_id AND h.side = 'home' JOIN form a ON a.match_id = m.match_id AND a.side = 'away' JOIN h2h x ON x.match_id = m.match_id)"""


def features(m: DataFrame) -> DataFrame:
    """The 27 features of every match, with target and status. The three parts share the match id as join key."""
    m = written(m)
    rows = form.rolling_form(m)

    def side(name: str) -> DataFrame:
        columns = []
        for k in form.WINDOWS:
            columns += [F.col(f"points_{k}").alias(f"{name}_form_{k}"), F.col(f"available_{k}").alias(f"{name}_form_{k}_available"), F.col(f"goals_for_{k}").alias(f"{name}_goals_for_{k}"), F.col(f"goals_against_{k}").alias(f"{name}_goals_against_{k}")]
        return rows.where(F.col("side") == name).select("match_id", *columns, F.col("played").alias(f"{name}_matches_played"))

    ratings = elo.elo_walk(m).select("match_id", F.col("home_elo").alias("home_elo_pre"), F.col("away_elo").alias("away_elo_pre"), "elo_diff", F.lit(1).alias("elo_available"))
    meetings = form.head_to_head(m).select("match_id", F.col("home_wins").alias("h2h_home_wins"), F.col("draws").alias("h2h_draws"), F.col("away_wins").alias("h2h_away_wins"), F.col("available").alias("h2h_available"), F.col("meetings").alias("h2h_matches"))
    base = m.select("match_id", "kickoff_at", "league", O.outcome(F.col("home_score"), F.col("away_score")).alias("target"), "status")
    return base.join(ratings, "match_id").join(side("home"), "match_id").join(side("away"), "match_id").join(meetings, "match_id")


@query(FEATURES + " SELECT * EXCLUDE (status) REPLACE (round(home_elo_pre, 6) AS home_elo_pre, round(away_elo_pre, 6) AS away_elo_pre, round(elo_diff, 6) AS elo_diff), CAST(target = 'HOME' AS INT) AS home_win, CAST(target = 'DRAW' AS INT) AS draw, CAST(target = 'AWAY' AS INT) AS away_win FROM feats WHERE status = 'finished'")
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table: finished matches with features, target and one-hot target."""
    rows = features(bridge.matches(spark, sf_dir)).where("status = 'finished'").drop("status")
    hot = {name: (F.col("target") == label).cast("int") for name, label in (("home_win", "HOME"), ("draw", "DRAW"), ("away_win", "AWAY"))}
    return rows.withColumns({c: F.round(c, 6) for c in ("home_elo_pre", "away_elo_pre", "elo_diff")}).withColumns(hot)


@query(FEATURES + " SELECT * EXCLUDE (status, target) REPLACE (round(home_elo_pre, 6) AS home_elo_pre, round(away_elo_pre, 6) AS away_elo_pre, round(elo_diff, 6) AS elo_diff) FROM feats WHERE status = 'scheduled'")
def prematch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of scheduled matches, without any label column."""
    rows = features(bridge.matches(spark, sf_dir)).where("status = 'scheduled'").drop("status", "target")
    return rows.withColumns({c: F.round(c, 6) for c in ("home_elo_pre", "away_elo_pre", "elo_diff")})


REJECTS = """
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN match_id % 50 = 0 THEN 'data_mode_mock' WHEN match_id % 51 = 0 THEN 'missing_home_team' WHEN match_id % 53 = 0 THEN 'missing_away_team' WHEN status <> 'finished' THEN 'not_finished'
    WHEN home_score IS NULL THEN 'missing_score' WHEN copy > 1 THEN 'duplicate_match' ELSE 'accepted' END AS reason
  FROM (SELECT *, 1 AS copy FROM m UNION ALL SELECT *, 2 FROM m WHERE match_id % 10 = 3)) GROUP BY reason"""


@query(REJECTS)
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching rejection of each candidate; of accepted repeats the first is kept."""
    m = bridge.matches(spark, sf_dir)
    k = F.col("match_id")
    marked = m.withColumns({
        "arrival": F.lit(1), "data_mode": F.when(k % 50 == 0, "mock").otherwise("live"),
        "home": F.when(k % 51 != 0, F.col("home_team_id")), "away": F.when(k % 53 != 0, F.col("away_team_id")),
    })
    pool = marked.unionByName(marked.where(k % 10 == 3).withColumn("arrival", F.lit(2)))
    return reject_counts(pool)


def reject_counts(pool: DataFrame) -> DataFrame:
    reason = (
        F.when(F.col("data_mode") == "mock", "data_mode_mock").when(F.col("home").isNull(), "missing_home_team").when(F.col("away").isNull(), "missing_away_team")
        .when(F.col("status") != "finished", "not_finished").when(F.col("home_score").isNull() | F.col("away_score").isNull(), "missing_score")
    )
    first = F.row_number().over(Window.partitionBy("match_id", reason.isNull()).orderBy("arrival")) == 1
    final = F.coalesce(reason, F.when(first, "accepted").otherwise("duplicate_match"))
    return pool.select(final.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(ELO + """, gap AS (SELECT abs(home_elo - away_elo) AS x FROM elo)
SELECT round(min(x), 4) AS low, round(quantile_cont(x, 0.1), 4) AS p10, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.9), 4) AS p90, round(max(x), 4) AS high, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std FROM gap""")
def elo_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = written(elo.elo_walk(bridge.matches(spark, sf_dir)).select(F.abs("elo_diff").alias("x")))
    shown = gaps.agg(F.round(F.min("x"), 4).alias("low"), F.round(F.max("x"), 4).alias("high"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_pop("x"), 4).alias("std"))
    found = metrics.exact_percentiles(gaps, "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    # One row each.
    return shown.join(F.broadcast(found), F.lit(True), "left").select("low", *(F.round(c, 4).alias(c) for c in ("p10", "p50", "p90")), "high", "mean", "std")


@query(ELO_GRID + """, gp AS (SELECT k, ha, CASE y WHEN 'DRAW' THEN dr WHEN 'HOME' THEN (1e0 - dr) * e ELSE (1e0 - dr) * (1e0 - e) END AS p FROM (
  SELECT k, ha, CASE WHEN home_score > away_score THEN 'HOME' WHEN home_score < away_score THEN 'AWAY' ELSE 'DRAW' END AS y,
    1e0 / (1e0 + pow(10e0, -((elo_diff + ha) / 400e0))) AS e, least(greatest(0.26e0 * exp(-0.8e0 * abs(elo_diff) / 400e0), 0.05e0), 0.42e0) AS dr
  FROM elo JOIN m ON m.match_id = elo.match_id WHERE status = 'finished')),
gc AS (SELECT CAST(k AS INT) AS k, CAST(ha AS INT) AS ha, avg(-ln(greatest(p, 1e-15))) AS log_loss, count(*) AS n FROM gp GROUP BY k, ha)
SELECT k, ha, round(log_loss, 8) AS log_loss, n, row_number() OVER (ORDER BY round(log_loss, 8), k, ha) AS cell_rank, round(min(log_loss) OVER (), 8) AS best, round(max(log_loss) OVER () - min(log_loss) OVER (), 8) AS spread, k = 20 AND ha = 80 AS candidate FROM gc""")
def elo_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-loss of every pair of step size and home advantage, ranked, with the range over the grid and the candidate in
    use marked. The windows range over one row a cell."""
    m = bridge.matches(spark, sf_dir)
    y = F.when(F.col("status") == "finished", O.outcome(F.col("home_score"), F.col("away_score")))
    joined = elo.elo_grid(m.withColumns({"y": y, "finished": F.col("status") == "finished"}), KS, ADVANTAGES, carry=("y", "finished")).where("finished")
    diff = F.col("home_elo") - F.col("away_elo")
    expected = F.lit(1e0) / (F.lit(1e0) + F.pow(F.lit(1e1), -((diff + F.col("ha")) / 400e0)))
    draw = F.least(F.greatest(F.lit(0.26) * F.exp(F.lit(-0.8) * F.abs(diff) / 400e0), F.lit(0.05)), F.lit(0.42))
    p = F.when(F.col("y") == "DRAW", draw).when(F.col("y") == "HOME", (1 - draw) * expected).otherwise((1 - draw) * (1 - expected))
    cells = joined.groupBy("k", "ha").agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15)))).alias("loss"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    low, high = F.min("loss").over(every), F.max("loss").over(every)
    ranked = cells.withColumns({"log_loss": F.round("loss", 8), "best": F.round(low, 8), "spread": F.round(high - low, 8), "candidate": (F.col("k") == elo.K) & (F.col("ha") == elo.HOME_ADVANTAGE)})
    return ranked.withColumn("cell_rank", F.row_number().over(Window.orderBy("log_loss", "k", "ha"))).drop("loss")
