"""Splits, models, calibration, ensembles and validation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import odds as O
from ..operators import elo, metrics, models
from ..session import written
from ..sources import bridge
from .history import ELO, FEATURES, features
from .registry import query
from .reports import LABELLED, labelled, rounded

#: (fold, train start, validation start, validation end): expanding walk-forward on the test data's years.
FOLDS = [("fold_1", "1995-01-01", "1997-01-01", "1998-01-01"), ("fold_2", "1995-01-01", "1998-01-01", "1999-01-01"), ("fold_3", "1995-01-01", "1999-01-01", "2000-01-01")]
TRAIN_END, SELECT_START, TEST_START = "1999-01-01", "2000-01-01", "2000-09-01"
PERIODS = [("train", TRAIN_END), ("calibration_fit", SELECT_START), ("calibration_select", TEST_START)]

FOLD_SQL = "(VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}', TIMESTAMP '{c}')" for n, a, b, c in FOLDS) + ") f(fold, a, b, c)"
ROLES = f""", roles AS (SELECT fold, CASE WHEN kickoff_at < b THEN 'train' ELSE 'validation' END AS role, q.* FROM q JOIN {FOLD_SQL} ON kickoff_at >= a AND kickoff_at < c)"""
PERIOD_SQL = "CASE " + " ".join(f"WHEN kickoff_at < TIMESTAMP '{end}' THEN '{name}'" for name, end in PERIODS) + " ELSE 'final_test' END"


@query(LABELLED + ROLES + " SELECT fold, role, count(*) AS n, min(kickoff_at) AS first_at, max(kickoff_at) AS last_at FROM roles GROUP BY fold, role")
def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.split_roles(labelled(spark, sf_dir), FOLDS)
    return rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("kickoff_at").alias("first_at"), F.max("kickoff_at").alias("last_at"))


@query(LABELLED + f" SELECT {PERIOD_SQL} AS period, count(*) AS n FROM q GROUP BY 1")
def split_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy(models.period_of(F.col("kickoff_at"), PERIODS, "final_test").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query(LABELLED + ROLES + """ SELECT fold, round(avg(CAST(y = 'HOME' AS INT)), 6) AS p_home, round(avg(CAST(y = 'DRAW' AS INT)), 6) AS p_draw, round(avg(CAST(y = 'AWAY' AS INT)), 6) AS p_away, count(*) AS n FROM roles WHERE role = 'train' GROUP BY fold""")
def frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = models.split_roles(labelled(spark, sf_dir), FOLDS).where("role = 'train'")
    return rounded(models.class_frequencies(train, by=["fold"]), "p_home", "p_draw", "p_away")


MODEL_ROWS = LABELLED + ROLES + """, freq AS (SELECT fold, avg(CAST(y = 'HOME' AS INT)) AS h, avg(CAST(y = 'DRAW' AS INT)) AS dd, avg(CAST(y = 'AWAY' AS INT)) AS aa FROM roles WHERE role = 'train' GROUP BY fold),
mr AS (SELECT 'rating' AS model, fold, match_id, y, p_home, p_draw, p_away FROM roles WHERE role = 'validation'
  UNION ALL SELECT 'frequency', r.fold, match_id, y, h, dd, aa FROM roles r JOIN freq ON freq.fold = r.fold WHERE role = 'validation'),
ml AS (SELECT model, fold, avg(-ln(CASE y WHEN 'HOME' THEN p_home WHEN 'DRAW' THEN p_draw ELSE p_away END)) AS log_loss,
  avg((p_home - CAST(y = 'HOME' AS INT))^2 + (p_draw - CAST(y = 'DRAW' AS INT))^2 + (p_away - CAST(y = 'AWAY' AS INT))^2) AS brier FROM mr GROUP BY model, fold)"""


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rows of every fold with the probabilities of two models."""
    rows = models.split_roles(labelled(spark, sf_dir), FOLDS)
    freq = models.class_frequencies(rows.where("role = 'train'"), by=["fold"]).drop("n")
    held = rows.where("role = 'validation'").select("fold", "match_id", "y", "p_home", "p_draw", "p_away")
    # One row a fold.
    by_frequency = held.select("fold", "match_id", "y").join(F.broadcast(freq), "fold").withColumn("model", F.lit("frequency"))
    return held.withColumn("model", F.lit("rating")).unionByName(by_frequency)


def fold_losses(rows: DataFrame) -> DataFrame:
    p = [F.col(c) for c in ("p_home", "p_draw", "p_away")]
    scored = rows.withColumns({"p_y": O.probability_of(F.col("y"), *p), "predicted": O.argmax_1x2(*p)})
    return metrics.class_metrics(scored, ["model", "fold"])


@query(MODEL_ROWS + " SELECT model, round(avg(log_loss), 6) AS mean_log_loss, round(avg(brier), 6) AS mean_brier, count(*) AS folds FROM ml GROUP BY model ORDER BY 2, 3")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = fold_losses(model_rows(spark, sf_dir)).groupBy("model").agg(F.avg("log_loss").alias("mean_log_loss"), F.avg("brier").alias("mean_brier"), F.count(F.lit(1)).alias("folds"))
    return rounded(means, "mean_log_loss", "mean_brier").orderBy("mean_log_loss", "mean_brier")


ENSEMBLE = MODEL_ROWS + """, aw AS (SELECT model, (1e0 / avg(log_loss)) AS inv FROM ml GROUP BY model), wt AS (SELECT model, inv / sum(inv) OVER () AS weight FROM aw),
mix AS (SELECT fold, match_id, y, sum(weight * p_home) AS p_home, sum(weight * p_draw) AS p_draw, sum(weight * p_away) AS p_away FROM mr JOIN wt ON wt.model = mr.model GROUP BY fold, match_id, y)"""


@query(ENSEMBLE + " SELECT model, round(weight, 6) AS weight FROM wt")
def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = fold_losses(model_rows(spark, sf_dir)).groupBy("model").agg(F.avg("log_loss").alias("log_loss"))
    return models.ensemble_weights(losses).select("model", F.round("weight", 6).alias("weight"))


@query(ENSEMBLE + """, best AS (SELECT min(l) AS single FROM (SELECT model, avg(log_loss) AS l FROM ml GROUP BY model)), one AS (SELECT avg(l) AS mixed FROM (SELECT fold, avg(-ln(CASE y WHEN 'HOME' THEN p_home WHEN 'DRAW' THEN p_draw ELSE p_away END)) AS l FROM mix GROUP BY fold))
SELECT round(single, 6) AS best_single, round(mixed, 6) AS mixed, single - mixed > 1e-4 AS kept FROM best, one""")
def ensemble_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the weighted mixture beats the best single model by more than 1e-4."""
    rows = model_rows(spark, sf_dir)
    single = fold_losses(rows).groupBy("model").agg(F.avg("log_loss").alias("log_loss"))
    weights = models.ensemble_weights(single)
    mixed = rows.join(F.broadcast(weights.select("model", "weight")), "model").groupBy("fold", "match_id", "y").agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("p_home", "p_draw", "p_away")))
    loss = fold_losses(mixed.withColumn("model", F.lit("mix"))).agg(F.avg("log_loss").alias("mixed"))
    best = single.agg(F.min("log_loss").alias("best_single")).crossJoin(F.broadcast(loss))
    return best.select(F.round("best_single", 6).alias("best_single"), F.round("mixed", 6).alias("mixed"), (F.col("best_single") - F.col("mixed") > 1e-4).alias("kept"))


FACTORIALS = ", ".join(f"{math.factorial(k)}e0" for k in range(11))
POISSON = FEATURES + f""", tr AS (SELECT * FROM feats WHERE status = 'finished' AND kickoff_at < TIMESTAMP '{TRAIN_END}'),
mean AS (SELECT coalesce(avg(home_goals_for_5 / 5e0) FILTER (WHERE home_form_5_available = 1), 1.3e0) AS hf, coalesce(avg(home_goals_against_5 / 5e0) FILTER (WHERE home_form_5_available = 1), 1.3e0) AS ha,
  coalesce(avg(away_goals_for_5 / 5e0) FILTER (WHERE away_form_5_available = 1), 1.3e0) AS af, coalesce(avg(away_goals_against_5 / 5e0) FILTER (WHERE away_form_5_available = 1), 1.3e0) AS aga FROM tr),
lam AS (SELECT match_id, target, least(greatest(0.5e0 * (CASE WHEN home_form_5_available = 1 THEN home_goals_for_5 / 5e0 ELSE hf END + CASE WHEN away_form_5_available = 1 THEN away_goals_against_5 / 5e0 ELSE aga END), 0.2e0), 4.5e0) AS lh,
  least(greatest(0.5e0 * (CASE WHEN away_form_5_available = 1 THEN away_goals_for_5 / 5e0 ELSE af END + CASE WHEN home_form_5_available = 1 THEN home_goals_against_5 / 5e0 ELSE ha END), 0.2e0), 4.5e0) AS la FROM feats, mean WHERE status = 'finished'),
gg AS (SELECT match_id, lh, la, target, x.i AS i, y.i AS j, exp(-lh) * pow(lh, x.i) / [{FACTORIALS}][x.i + 1] * exp(-la) * pow(la, y.i) / [{FACTORIALS}][y.i + 1] AS pr FROM lam, range(11) x(i), range(11) y(i)),
po AS (SELECT match_id, any_value(lh) AS lh, any_value(la) AS la, sum(pr) FILTER (WHERE i > j) AS h, sum(pr) FILTER (WHERE i = j) AS dd, sum(pr) FILTER (WHERE i < j) AS aa FROM gg GROUP BY match_id)"""


@query(POISSON + " SELECT match_id, round(lh, 6) AS lambda_home, round(la, 6) AS lambda_away, round(h / (h + dd + aa), 6) AS p_home, round(dd / (h + dd + aa), 6) AS p_draw, round(aa / (h + dd + aa), 6) AS p_away FROM po")
def poisson_1x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent Poisson goals with rates from recent form; training means stand in for short histories."""
    rows = written(features(bridge.matches(spark, sf_dir)).where("status = 'finished'"))
    means = models.mean_goal_rates(rows.where(F.col("kickoff_at") < F.lit(TRAIN_END).cast("timestamp_ntz")))
    rates = models.goal_rates(rows, means)
    p = O.poisson_1x2(F.col("lambda_home"), F.col("lambda_away"))
    return rates.select("match_id", F.round("lambda_home", 6).alias("lambda_home"), F.round("lambda_away", 6).alias("lambda_away"), *(F.round(c, 6).alias(n) for c, n in zip(p, ("p_home", "p_draw", "p_away"))))


ELO_P = ELO + """, ed AS (SELECT elo.match_id, elo_diff, 1e0 / (1e0 + pow(10e0, -((elo_diff + 80e0) / 400e0))) AS e, least(greatest(0.26e0 * exp(-0.8e0 * abs(elo_diff) / 400e0), 0.05e0), 0.42e0) AS dr FROM elo)"""


@query(ELO_P + " SELECT match_id, round((1e0 - dr) * e, 6) AS p_home, round(dr, 6) AS p_draw, round((1e0 - dr) * (1e0 - e), 6) AS p_away FROM ed")
def elo_1x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the frozen rating model."""
    walked = elo.elo_walk(bridge.matches(spark, sf_dir))
    p = O.elo_1x2(F.col("elo_diff"))
    return walked.select("match_id", *(F.round(c, 6).alias(n) for c, n in zip(p, ("p_home", "p_draw", "p_away"))))


@query(ELO + f""", dt AS MATERIALIZED (SELECT round_even(elo_diff, 0) AS diff, CASE WHEN home_score > away_score THEN 'HOME' WHEN home_score < away_score THEN 'AWAY' ELSE 'DRAW' END AS y, count(*) AS n
  FROM elo JOIN m ON m.match_id = elo.match_id WHERE status = 'finished' AND kickoff_at < TIMESTAMP '{TRAIN_END}' GROUP BY 1, 2),
dc AS (SELECT 0.12e0 + 0.02e0 * i AS draw_base, 0.25e0 * j AS draw_decay FROM range(15) a(i), range(17) b(j)),
dp AS (SELECT draw_base, draw_decay, y, n, greatest((1e0 - dr) * e, 1e-15) AS h, greatest(dr, 1e-15) AS dd, greatest((1e0 - dr) * (1e0 - e), 1e-15) AS aa FROM (
  SELECT *, 1e0 / (1e0 + pow(10e0, -((diff + 80e0) / 400e0))) AS e, least(greatest(draw_base * exp(-draw_decay * abs(diff) / 400e0), 0.05e0), 0.42e0) AS dr FROM dt, dc)),
dl AS (SELECT draw_base, draw_decay, sum(-ln(CASE y WHEN 'HOME' THEN h WHEN 'DRAW' THEN dd ELSE aa END / (h + dd + aa)) * n) / sum(n) AS log_loss FROM dp GROUP BY 1, 2)
SELECT round(draw_base, 6) AS draw_base, round(draw_decay, 6) AS draw_decay, round(log_loss, 8) AS log_loss FROM dl ORDER BY round(log_loss, 8), draw_base, draw_decay LIMIT 5""")
def elo_draw_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw parameters by grid, best first: a fitted model, in place of a bounded quasi-Newton search."""
    m = bridge.matches(spark, sf_dir)
    train = m.where((F.col("status") == "finished") & (F.col("kickoff_at") < F.lit(TRAIN_END).cast("timestamp_ntz"))).select("match_id", O.outcome(F.col("home_score"), F.col("away_score")).alias("y"))
    rows = elo.elo_walk(m).join(train, "match_id").select("elo_diff", "y")
    grid = models.draw_transform_grid(rows, [0.12 + 0.02 * i for i in range(15)], [0.25 * i for i in range(17)])
    shown = grid.select(*(F.round(c, d).alias(c) for c, d in (("draw_base", 6), ("draw_decay", 6), ("log_loss", 8))))
    return shown.orderBy("log_loss", "draw_base", "draw_decay").limit(5)


POINTS = [(0.26, 0.8), (0.12, 0.0), (0.40, 4.0), (0.33, 0.1), (0.2, 2.5)]
POINT_SQL = ", ".join(f"({i}, {b}e0, {d}e0)" for i, (b, d) in enumerate(POINTS))


def draw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating differences and outcomes of the training period."""
    m = bridge.matches(spark, sf_dir)
    train = m.where((F.col("status") == "finished") & (F.col("kickoff_at") < F.lit(TRAIN_END).cast("timestamp_ntz"))).select("match_id", O.outcome(F.col("home_score"), F.col("away_score")).alias("y"))
    return elo.elo_walk(m).join(train, "match_id").select("elo_diff", "y")


@query(ELO + f""", db AS MATERIALIZED (SELECT abs(round_even(elo_diff, 0)) / 400e0 AS u, count(*) AS n, count(*) FILTER (WHERE home_score = away_score) AS k FROM elo JOIN m ON m.match_id = elo.match_id WHERE status = 'finished' AND kickoff_at < TIMESTAMP '{TRAIN_END}' GROUP BY 1),
pt AS (SELECT * FROM (VALUES {POINT_SQL}) v(point, base, decay)),
dv AS (SELECT *, base * exp(-decay * u) AS fr, least(greatest(base * exp(-decay * u), 0.05e0), 0.42e0) AS p FROM db, pt),
ds AS (SELECT *, CASE WHEN fr > 0.05e0 AND fr < 0.42e0 THEN (n - k) / (1 - p) - k / p ELSE 0e0 END AS slope FROM dv)
SELECT CAST(point AS INT) AS point, round(sum(-k * ln(p) - (n - k) * ln(1 - p)) / sum(n), 8) AS loss, round(sum(slope * exp(-decay * u)) / sum(n), 8) AS g_base, round(sum(-slope * u * p) / sum(n), 8) AS g_decay FROM ds GROUP BY point""")
def draw_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and gradient of the draw transform at five points, limits of the bounds among them."""
    found = models.draw_derivatives(models.draw_bins(draw_rows(spark, sf_dir)), POINTS)
    return found.select("point", *(F.round(c, 8).alias(c) for c in ("loss", "g_base", "g_decay")))


@query()
def bounded_draw_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draw transform fitted within its bounds by projected Newton steps; tests hold it against the grid."""
    fit = models.fitted_draw_transform(draw_rows(spark, sf_dir))
    return spark.createDataFrame([(round(fit["draw_base"], 6), round(fit["draw_decay"], 5), round(fit["log_loss"], 9))], "draw_base double, draw_decay double, log_loss double")


def periods(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    # Fits pass over the rows many times.
    rows = written(labelled(spark, sf_dir).withColumn("period", models.period_of(F.col("kickoff_at"), PERIODS, "final_test")))
    return {name: rows.where(F.col("period") == name) for name in ("train", "calibration_fit", "calibration_select", "final_test")}


@query()
def calibration_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-loss of raw, sigmoid and isotonic probabilities on the selection period, best first: fitted models."""
    parts = periods(spark, sf_dir)
    fit, held = parts["calibration_fit"], parts["calibration_select"]
    return models.calibration_losses(fit, held).orderBy("log_loss")


@query(LABELLED + f""", cf AS (SELECT q.* FROM q WHERE {PERIOD_SQL} = 'calibration_fit'),
cb AS (SELECT class, round_even(x, 3) AS x, count(*) AS n, count(*) FILTER (WHERE y = class) AS hits FROM (SELECT y, unnest(['HOME', 'DRAW', 'AWAY']) AS class, unnest([p_home, p_draw, p_away]) AS x FROM cf) GROUP BY 1, 2),
cs AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(hits) OVER w AS ch FROM cb WINDOW w AS (PARTITION BY class ORDER BY x)),
jk AS (SELECT a.class, a.i AS j, b.i AS k, (b.ch - a.ch + a.hits) / (b.cn - a.cn + a.n) AS mean FROM cs a JOIN cs b ON b.class = a.class AND b.i >= a.i),
ji AS (SELECT class, j, k AS i, min(mean) OVER (PARTITION BY class, j ORDER BY k DESC) AS low FROM jk)
SELECT class, round(x, 3) AS x, n, round(max(low), 8) AS value FROM ji JOIN cs USING (class, i) GROUP BY class, x, n""")
def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The isotonic fit of the calibration period at its bins: pooled by a stack here, by the largest smallest mean in SQL."""
    points = models.isotonic_points(periods(spark, sf_dir)["calibration_fit"])
    rows = [(c, round(x, 3), n, round(value, 8)) for c, of in points.items() for x, n, value in of]
    return spark.createDataFrame(rows, "class string, x double, n long, value double")


@query()
def calibration_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen calibration, fitted on both calibration periods, on the final one: its loss beside the raw one."""
    parts = periods(spark, sf_dir)
    chosen, rows = models.calibrated_finally(parts["calibration_fit"], parts["calibration_select"], parts["final_test"])
    loss = lambda prefix: F.round(F.avg(models.log_loss_of(F.col("y"), *(F.col(f"{prefix}_{c}") for c in ("home", "draw", "away")))), 6)
    return rows.agg(F.count(F.lit(1)).alias("n"), loss("p").alias("raw_loss"), loss("c").alias("calibrated_loss")).withColumn("method", F.lit(chosen))


@query()
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient-boosted trees on the features without availability of ratings, scored on the final period."""
    rows = written(features(bridge.matches(spark, sf_dir)).where("status = 'finished'").withColumnRenamed("target", "y"))
    names = [c for c, kind in rows.dtypes if c not in ("match_id", "kickoff_at", "league", "y", "status", "elo_available")]
    at = F.col("kickoff_at")
    train, test = rows.where(at < F.lit(TRAIN_END).cast("timestamp_ntz")), rows.where(at >= F.lit(TEST_START).cast("timestamp_ntz"))
    scored = models.boosted_trees(train, test, names)
    p = [F.col(c) for c in ("p_home", "p_draw", "p_away")]
    return metrics.class_metrics(scored.withColumns({"p_y": O.probability_of(F.col("y"), *p), "predicted": O.argmax_1x2(*p)}))


@query(LABELLED + f""", seg AS (SELECT league, {PERIOD_SQL} AS period, q.* EXCLUDE (league) FROM q), fq AS (SELECT league, avg(CAST(y = 'HOME' AS INT)) AS h, avg(CAST(y = 'DRAW' AS INT)) AS dd, avg(CAST(y = 'AWAY' AS INT)) AS aa FROM seg WHERE period = 'train' GROUP BY league),
lg AS (SELECT seg.league, count(*) AS n, avg(-ln(p_y)) AS model_loss, avg(-ln(CASE y WHEN 'HOME' THEN h WHEN 'DRAW' THEN dd ELSE aa END)) AS base_loss FROM seg JOIN fq ON fq.league = seg.league WHERE period = 'final_test' GROUP BY seg.league)
SELECT league, n, round(model_loss, 6) AS model_loss, round(base_loss, 6) AS base_loss, model_loss > base_loss + 0.02 AS collapsed FROM lg""")
def segment_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitions in which the model is worse than class frequencies by more than 0.02."""
    parts = periods(spark, sf_dir)
    base = models.class_frequencies(parts["train"], by=["league"]).select("league", F.col("p_home").alias("b_home"), F.col("p_draw").alias("b_draw"), F.col("p_away").alias("b_away"))
    p_base = O.probability_of(F.col("y"), F.col("b_home"), F.col("b_draw"), F.col("b_away"))
    loss = parts["final_test"].join(base, "league").groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.avg(-F.log("p_y")).alias("model_loss"), F.avg(-F.log(p_base)).alias("base_loss"))
    return rounded(loss.withColumn("collapsed", F.col("model_loss") > F.col("base_loss") + 0.02), "model_loss", "base_loss")


FROZEN = {"status": "candidate", "selected_model": "elo", "train_end": TRAIN_END, "select_end": TEST_START, "test_start": TEST_START}
#: Registered cards; row counts are those of the card "right" plus what is written here.
CARDS = [("right", "candidate", "elo", TRAIN_END, TEST_START, TEST_START, 0), ("promoted", "production", "elo", TRAIN_END, TEST_START, TEST_START, 0), ("late", "candidate", "poisson", TRAIN_END, "2000-12-01", TEST_START, 0), ("miscounted", "candidate", "elo", "1998-01-01", TEST_START, TEST_START, 7)]
CARD_SQL = ", ".join(f"('{v}', '{s}', '{m}', '{a}', '{b}', '{c}', {extra})" for v, s, m, a, b, c, extra in CARDS)


@query(LABELLED + f""", cards AS (SELECT * FROM (VALUES {CARD_SQL}) v(model_version, status, selected_model, train_end, select_end, test_start, extra)),
ct AS (SELECT model_version, count(*) FILTER (WHERE kickoff_at < CAST(train_end AS TIMESTAMP)) AS train, count(*) FILTER (WHERE kickoff_at >= CAST(train_end AS TIMESTAMP) AND kickoff_at < CAST(select_end AS TIMESTAMP)) AS sel, count(*) FILTER (WHERE kickoff_at >= CAST(test_start AS TIMESTAMP)) AS test FROM q, cards GROUP BY model_version),
al AS (SELECT cards.*, ct.*, r.train AS rt, r.sel AS rs, r.test AS re FROM cards JOIN ct ON ct.model_version = cards.model_version, (SELECT * FROM ct WHERE model_version = 'right') r)
SELECT model_version, unnest(['status', 'selected_model', 'train_end', 'select_end', 'test_start', 'select_ends_at_test', 'train_rows', 'select_rows', 'test_rows']) AS check_name,
  unnest([status = 'candidate', selected_model = 'elo', train_end = '{TRAIN_END}', select_end = '{TEST_START}', test_start = '{TEST_START}', select_end = test_start, rt + extra > 0 AND train = rt + extra, rs + extra > 0 AND sel = rs + extra, re + extra > 0 AND test = re + extra]) AS ok FROM al""")
def provenance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered cards, one of them right, against the frozen protocol and the rows of the table."""
    rows = labelled(spark, sf_dir)
    at, time = F.col("kickoff_at"), lambda s: F.lit(s).cast("timestamp_ntz")
    counts = rows.agg(F.count_if(at < time(TRAIN_END)).alias("t"), F.count_if((at >= time(TRAIN_END)) & (at < time(TEST_START))).alias("s"), F.count_if(at >= time(TEST_START)).alias("e"))
    cards = spark.createDataFrame(CARDS, "model_version string, status string, selected_model string, train_end string, select_end string, test_start string, extra long").crossJoin(F.broadcast(counts))
    cards = cards.withColumns({"train_rows": F.col("t") + F.col("extra"), "select_rows": F.col("s") + F.col("extra"), "test_rows": F.col("e") + F.col("extra")}).drop("t", "s", "e", "extra")
    return models.provenance(cards, rows, FROZEN)
