"""Metrics, calibration, settlement and strategy reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import odds as O
from ..operators import asof, metrics, value
from ..sources import bridge
from .catalog import VALUES, values
from .registry import query

LABELLED = """, l AS (
  SELECT m.match_id, league, season, kickoff_at, CASE WHEN home_score > away_score THEN 'HOME' WHEN home_score < away_score THEN 'AWAY' ELSE 'DRAW' END AS y, p_home, p_draw, p_away,
    CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'HOME' WHEN p_draw >= p_away THEN 'DRAW' ELSE 'AWAY' END AS predicted, greatest(p_home, p_draw, p_away) AS confidence
  FROM m JOIN p ON p.match_id = m.match_id WHERE status = 'finished'),
q AS (SELECT *, CASE y WHEN 'HOME' THEN p_home WHEN 'DRAW' THEN p_draw ELSE p_away END AS p_y,
  (p_home - CAST(y = 'HOME' AS INT)) * (p_home - CAST(y = 'HOME' AS INT)) + (p_draw - CAST(y = 'DRAW' AS INT)) * (p_draw - CAST(y = 'DRAW' AS INT)) + (p_away - CAST(y = 'AWAY' AS INT)) * (p_away - CAST(y = 'AWAY' AS INT)) AS brier FROM l)"""
CLASS_METRICS = "count(*) AS n, round(avg(-ln(greatest(p_y, 1e-15))), 6) AS log_loss, round(avg(brier), 6) AS brier, round(avg(CAST(predicted = y AS DOUBLE)), 6) AS accuracy"
BIN = "CASE WHEN {p} >= 0.9e0 THEN 9 WHEN {p} >= 0.8e0 THEN 8 WHEN {p} >= 7 * 0.1e0 THEN 7 WHEN {p} >= 6 * 0.1e0 THEN 6 WHEN {p} >= 0.5e0 THEN 5 WHEN {p} >= 0.4e0 THEN 4 WHEN {p} >= 3 * 0.1e0 THEN 3 WHEN {p} >= 0.2e0 THEN 2 WHEN {p} >= 0.1e0 THEN 1 ELSE 0 END"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    return metrics.labelled(m, bridge.predictions(m))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(LABELLED + f" SELECT {CLASS_METRICS} FROM q")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_metrics(labelled(spark, sf_dir)), "log_loss", "brier", "accuracy")


@query(LABELLED + f" SELECT league, {CLASS_METRICS} FROM q GROUP BY league")
def grouped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_metrics(labelled(spark, sf_dir), ["league"]), "log_loss", "brier", "accuracy")


@query(LABELLED + """, c AS (SELECT y, predicted, unnest(['HOME', 'DRAW', 'AWAY']) AS class, unnest([p_home, p_draw, p_away]) AS p FROM q)
SELECT class, count(*) FILTER (WHERE y = class) AS support,
  round(CASE WHEN count(*) FILTER (WHERE predicted = class) > 0 THEN count(*) FILTER (WHERE y = class AND predicted = class) / count(*) FILTER (WHERE predicted = class) ELSE 0e0 END, 6) AS precision,
  round(CASE WHEN count(*) FILTER (WHERE y = class) > 0 THEN count(*) FILTER (WHERE y = class AND predicted = class) / count(*) FILTER (WHERE y = class) ELSE 0e0 END, 6) AS recall, round(avg(p), 6) AS mean_p,
  round(avg(CASE WHEN y = class THEN -ln(p) ELSE -ln(1e0 - p) END), 6) AS log_loss, round(avg((p - CAST(y = class AS INT)) * (p - CAST(y = class AS INT))), 6) AS brier FROM c GROUP BY class""")
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.per_class(labelled(spark, sf_dir)), "precision", "recall", "mean_p", "log_loss", "brier")


@query(LABELLED + f""", b AS (SELECT {BIN.format(p='confidence')} AS bin, count(*) AS n, avg(confidence) AS c, avg(CAST(predicted = y AS DOUBLE)) AS h FROM q GROUP BY 1)
SELECT round(sum(n * abs(h - c)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b""")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.expected_calibration_error(labelled(spark, sf_dir)), "ece")


RELIABLE = "SELECT CAST(r.bin AS INT) AS bin, coalesce(b.n, 0) AS n, round(coalesce(c, 0e0), 6) AS mean_p, round(coalesce(h, 0e0), 6) AS hit_rate FROM range(10) r(bin) LEFT JOIN b ON b.bin = r.bin"


@query(LABELLED + f", b AS (SELECT {BIN.format(p='confidence')} AS bin, count(*) AS n, avg(confidence) AS c, avg(CAST(predicted = y AS DOUBLE)) AS h FROM q GROUP BY 1) {RELIABLE}")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return rounded(metrics.reliability(rows, F.col("confidence"), F.col("predicted") == F.col("y")), "mean_p", "hit_rate")


@query(LABELLED + f", b AS (SELECT {BIN.format(p='p_draw')} AS bin, count(*) AS n, avg(p_draw) AS c, avg(CAST(y = 'DRAW' AS DOUBLE)) AS h FROM q GROUP BY 1) {RELIABLE}")
def draw_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return rounded(metrics.reliability(rows, F.col("p_draw"), F.col("y") == "DRAW"), "mean_p", "hit_rate")


@query(LABELLED + """ SELECT c.y, c.predicted, count(q.match_id) AS n FROM (SELECT * FROM (VALUES ('HOME'), ('DRAW'), ('AWAY')) a(y), (VALUES ('HOME'), ('DRAW'), ('AWAY')) b(predicted)) c
LEFT JOIN q ON q.y = c.y AND q.predicted = c.predicted GROUP BY c.y, c.predicted""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(labelled(spark, sf_dir))


BETS = VALUES + """, b AS (
  SELECT g.*, league, CASE WHEN home_score > away_score THEN 'HOME' WHEN home_score < away_score THEN 'AWAY' ELSE 'DRAW' END AS outcome FROM g JOIN m ON m.match_id = g.match_id WHERE m.status = 'finished'),
x AS (SELECT *, CAST(selection = outcome AS INT) AS hit, CASE WHEN selection = outcome THEN odds - 1 ELSE -1e0 END AS profit FROM b WHERE reason IS NULL)"""
STRATEGY = """count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 6) AS hit_rate, round(avg(odds), 6) AS avg_odds, round(avg(edge), 6) AS avg_edge, round(avg(ev), 6) AS avg_ev, round(sum(profit), 4) AS profit,
 round(sum(profit) / count(*), 6) AS roi, count(*) FILTER (WHERE selection = 'HOME') AS home, count(*) FILTER (WHERE selection = 'DRAW') AS draw, count(*) FILTER (WHERE selection = 'AWAY') AS away, count(*) < 30 AS small_sample, count(*) >= 250 AS robust"""


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled eligible picks."""
    m = bridge.matches(spark, sf_dir)
    eligible = value.gated(values(spark, sf_dir, m)).where(F.col("reason").isNull())
    return value.settled(eligible, m)


def tidy(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "hit_rate", "avg_odds", "avg_edge", "avg_ev", "roi"), "profit", digits=4)


@query(BETS + f" SELECT {STRATEGY} FROM x")
def strategy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.strategy(bets(spark, sf_dir)))


@query(BETS + f" SELECT league, {STRATEGY} FROM x GROUP BY league")
def strategy_by_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.strategy(bets(spark, sf_dir), ["league"]))


@query(BETS + " SELECT league, selection, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(sum(profit), 4) AS profit FROM x GROUP BY GROUPING SETS ((), (league), (selection))")
def strategy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals overall, by league and by selection in one pass."""
    x = bets(spark, sf_dir)
    sets = x.groupingSets([[], ["league"], ["selection"]], "league", "selection")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.round(F.sum("profit"), 4).alias("profit"))


@query(BETS + """ SELECT match_id, selection, league, round(profit, 4) AS profit, round(sum(profit) OVER w, 4) AS equity FROM x
WINDOW w AS (PARTITION BY league ORDER BY kickoff_at, match_id, selection ROWS UNBOUNDED PRECEDING)""")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.equity(bets(spark, sf_dir), ["league"])
    return rows.select("match_id", "selection", "league", F.round("profit", 4).alias("profit"), F.round("equity", 4).alias("equity"))


@query(BETS + """, e AS (SELECT *, sum(profit) OVER (PARTITION BY league ORDER BY kickoff_at, match_id, selection ROWS UNBOUNDED PRECEDING) AS eq FROM x),
f AS (SELECT *, greatest(0e0, max(eq) OVER (PARTITION BY league ORDER BY kickoff_at, match_id, selection ROWS UNBOUNDED PRECEDING)) - eq AS dd FROM e)
SELECT league, round(max(dd), 4) AS max_drawdown FROM f GROUP BY league""")
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.equity(bets(spark, sf_dir), ["league"]).groupBy("league").agg(F.round(F.max("drawdown"), 4).alias("max_drawdown"))


@query(BETS + """, i AS (SELECT *, sum(hit) OVER (PARTITION BY league ORDER BY kickoff_at, match_id, selection ROWS UNBOUNDED PRECEDING) AS island FROM x)
SELECT league, max(lost) AS longest_losing_streak FROM (SELECT league, island, count(*) FILTER (WHERE hit = 0) AS lost FROM i GROUP BY league, island) GROUP BY league""")
def losing_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.losing_streaks(bets(spark, sf_dir), ["league"])


@query(BETS + """ SELECT league, round(CASE WHEN l = 0 AND g = 0 THEN NULL WHEN l = 0 THEN 'inf'::DOUBLE ELSE g / l END, 6) AS profit_factor
FROM (SELECT league, sum(greatest(profit, 0e0)) AS g, sum(greatest(-profit, 0e0)) AS l FROM x GROUP BY league)""")
def profit_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.profit_factor(bets(spark, sf_dir), ["league"]), "profit_factor")


#: Report bins, half open: fixed values.
ODDS_BINS = [("<1.50", None, 1.50), ("1.50-2", 1.50, 2.0), ("2-3", 2.0, 3.0), ("3-5", 3.0, 5.0), (">5", 5.0, None)]
EDGE_BINS = [("<5%", None, 0.05), ("5-10%", 0.05, 0.10), ("10-20%", 0.10, 0.20), ("20-30%", 0.20, 0.30), (">30%", 0.30, None)]
EV_BINS = [("0-0.15", 0.0, 0.15), ("0.15-0.40", 0.15, 0.40), ("0.40-1.00", 0.40, 1.0), (">=1.00", 1.0, None)]
PROBABILITY_BINS = [("<20%", None, 0.20), ("20-30%", 0.20, 0.30), ("30-40%", 0.30, 0.40), ("40-50%", 0.40, 0.50), (">50%", 0.50, None)]
AGE_BINS = [("<0.25h", None, 0.25), ("0.25-2h", 0.25, 2.0), ("2-4h", 2.0, 4.0), ("4-24h", 4.0, 24.0), (">=24h", 24.0, None)]
ALL_BINS = (("odds", "odds", ODDS_BINS), ("edge", "edge", EDGE_BINS), ("ev", "ev", EV_BINS), ("probability", "p", PROBABILITY_BINS), ("age", "age_h", AGE_BINS))


def bin_sql() -> str:
    columns = {"p": "p_sel"}
    parts = []
    for kind, column, bins in ALL_BINS:
        for name, low, high in bins:
            column_ = columns.get(column, column)
            inside = " AND ".join([*([f"{column_} >= {low}e0"] if low is not None else []), *([f"{column_} < {high}e0"] if high is not None else [])])
            parts.append(f"SELECT '{kind}' AS kind, '{name}' AS label, count(*) AS n, coalesce(CAST(sum(hit) AS BIGINT), 0) AS hits, round(coalesce(sum(profit), 0e0), 4) AS profit FROM x WHERE {inside}")
    return "\nUNION ALL ".join(parts)


@query(BETS + " " + bin_sql())
def bucket_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets by odds, edge, EV, probability and age of the odds: each bet is offered to its five bins in one pass."""
    x = bets(spark, sf_dir)
    labels = []
    for kind, column, bins in ALL_BINS:
        value_, label = F.col(column), None
        for name, low, high in bins:
            inside = (value_ >= low if low is not None else F.lit(True)) & (value_ < high if high is not None else F.lit(True))
            label = F.when(inside, name) if label is None else label.when(inside, name)
        labels.append(F.struct(F.lit(kind).alias("kind"), label.alias("label")))
    counted = x.select("hit", "profit", F.explode(F.array(*labels)).alias("b")).groupBy("b.kind", "b.label").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.sum("profit").alias("profit"))
    names = spark.createDataFrame([(kind, b[0]) for kind, _, bins in ALL_BINS for b in bins], "kind string, label string")
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    return names.join(counted, ["kind", "label"], "left").select("kind", "label", zero("n", 0), zero("hits", 0), F.round(F.coalesce("profit", F.lit(0e0)), 4).alias("profit"))


@query(BETS + f""", c AS (
  SELECT 'picks' AS strategy, selection, odds, edge, ev, hit, profit FROM x
  UNION ALL SELECT 'argmax', selection, odds, edge, ev, CAST(selection = outcome AS INT), CASE WHEN selection = outcome THEN odds - 1 ELSE -1e0 END FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY p_sel DESC, selection DESC) AS r FROM b) WHERE r = 1
  UNION ALL SELECT 'home', selection, odds, edge, ev, CAST(selection = outcome AS INT), CASE WHEN selection = outcome THEN odds - 1 ELSE -1e0 END FROM b WHERE selection = 'HOME')
SELECT strategy, {STRATEGY} FROM c GROUP BY strategy""")
def strategy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible picks, the model's favourite and always-home on the same matches. One pass: every value row names the
    strategies that it belongs to; the favourite is found with the match's three rows together in one struct."""
    m = bridge.matches(spark, sf_dir)
    rows = value.gated(values(spark, sf_dir, m))
    favourite = O.argmax_1x2(F.col("p_home"), F.col("p_draw"), F.col("p_away"))
    named = F.array_compact(F.array(F.when(F.col("reason").isNull(), "picks"), F.when(F.col("selection") == favourite, "argmax"), F.when(F.col("selection") == "HOME", "home")))
    each = value.settled(rows, m).select("selection", "odds", "edge", "ev", "hit", "profit", F.explode(named).alias("strategy"))
    return tidy(metrics.strategy(each, ["strategy"]))


@query(BETS + """ SELECT CASE WHEN (SELECT count(*) FROM lo WHERE available_at > kickoff_at) > 0 THEN 'NO-GO' WHEN (SELECT count(*) FROM m WHERE status = 'finished') = 0 THEN 'INSUFFICIENT OOS EVIDENCE'
  WHEN count(*) < 250 OR 100e0 * count(DISTINCT match_id) / (SELECT count(*) FROM m WHERE status = 'finished') < 50 THEN 'INSUFFICIENT OOS EVIDENCE' ELSE 'GO WITH CONDITIONS' END AS verdict, count(*) AS n_picks FROM x""")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    picks = bets(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_picks"), F.countDistinct("match_id").alias("covered"))
    n = m.agg(F.count_if(F.col("status") == "finished").alias("n_matches"))
    late = asof.latest_odds(bridge.odds(spark, sf_dir, m)).agg(F.count_if(F.col("available_at") > F.col("kickoff_at")).alias("late"))
    # One row each.
    row = picks.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(late))
    thin = (F.col("n_matches") == 0) | (F.col("n_picks") < 250) | (F.lit(100e0) * F.col("covered") / F.greatest("n_matches", F.lit(1)) < 50)
    return row.select(F.when(F.col("late") > 0, "NO-GO").when(thin, "INSUFFICIENT OOS EVIDENCE").otherwise("GO WITH CONDITIONS").alias("verdict"), "n_picks")


@query(BETS + """ SELECT league, count(DISTINCT m2) AS matches, count(DISTINCT o) AS with_odds, round(100e0 * count(DISTINCT o) / count(DISTINCT m2), 6) AS pct FROM (
  SELECT m.league, m.match_id AS m2, lo.match_id AS o FROM m LEFT JOIN lo ON lo.match_id = m.match_id) GROUP BY league""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    last = asof.latest_odds(bridge.odds(spark, sf_dir, m)).select("match_id", F.lit(1).alias("has"))
    counted = m.join(last, "match_id", "left").groupBy("league").agg(F.count(F.lit(1)).alias("matches"), F.count("has").alias("with_odds"))
    return counted.withColumn("pct", F.round(F.lit(100e0) * F.col("with_odds") / F.col("matches"), 6))


@query(BETS + """, fr AS (SELECT run, match_id % 64 AS bucket, CAST('0x' || substr(sha256(concat_ws('|', match_id, selection, printf('%.6f', odds), printf('%.6f', round(score + bump, 6)))), 1, 15) AS BIGINT) AS h FROM (
  SELECT 'first' AS run, 0e0 AS bump, * FROM x UNION ALL SELECT 'again', 0e0, * FROM x UNION ALL SELECT 'changed', CASE WHEN match_id % 64 = 5 THEN 1e-3 ELSE 0e0 END, * FROM x)),
fs AS (SELECT run, bucket, count(*) AS n, CAST(sum(h) AS VARCHAR) AS fingerprint FROM fr GROUP BY run, bucket)
SELECT run, bucket, n, fingerprint, fingerprint = first(fingerprint) OVER (PARTITION BY bucket ORDER BY run = 'first' DESC) AS same FROM fs""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backtest's picks with odds and score, run twice, and once with a changed score: a fingerprint of each of 64 buckets
    of matches, and whether it is the first run's. Rows are hashed one by one and the hashes summed, before the shuffle as
    far as possible: no order is needed and no group is collected."""
    runs = {"first": F.lit(0e0), "again": F.lit(0e0), "changed": F.when(F.col("match_id") % 64 == 5, 1e-3).otherwise(0e0)}
    out = None
    for run, bump in runs.items():
        x = bets(spark, sf_dir).select("match_id", "selection", F.format_string("%.6f", "odds").alias("odds"), F.format_string("%.6f", F.round(F.col("score") + bump, 6)).alias("score"))
        one = metrics.fingerprints(x.withColumn("bucket", F.col("match_id") % 64), ["bucket"], ["match_id", "selection", "odds", "score"]).withColumn("run", F.lit(run))
        out = one if out is None else out.union(one)
    first = F.first("fingerprint").over(Window.partitionBy("bucket").orderBy((F.col("run") == "first").desc()))
    return out.withColumn("same", F.col("fingerprint") == first)
