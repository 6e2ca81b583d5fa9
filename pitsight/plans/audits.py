"""Audits of models, splits and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import elo, metrics, models, value
from ..session import written
from ..sources import bridge, readers
from .catalog import values
from .history import ELO, FEATURES, features
from .modelling import FACTORIALS, FOLDS, PERIODS, POISSON, ROLES, TRAIN_END
from .registry import query
from .reports import BETS, BIN, LABELLED, STRATEGY, bets, labelled, rounded, tidy

CLASS_ROWS = LABELLED + f""", cr AS (SELECT class, hit, p, {BIN.format(p='p')} AS bin FROM (SELECT unnest(['HOME', 'DRAW', 'AWAY']) AS class, unnest([p_home, p_draw, p_away]) AS p, unnest([y = 'HOME', y = 'DRAW', y = 'AWAY']) AS hit FROM q))"""


@query(CLASS_ROWS + """ SELECT class, round(sum(n * abs(h - c)) / sum(n), 6) AS ece FROM (SELECT class, bin, count(*) AS n, avg(p) AS c, avg(CAST(hit AS DOUBLE)) AS h FROM cr GROUP BY class, bin) GROUP BY class""")
def class_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error of each class on its own."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"p_{c.lower()}").alias("p"), (F.col("y") == c).alias("hit")) for c in metrics.CLASSES)))
    rows = labelled(spark, sf_dir).select(each.alias("x")).select("x.*")
    binned = rows.groupBy("class", metrics.bin_of(F.col("p")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("c"), F.avg(F.col("hit").cast("double")).alias("h"))
    return rounded(binned.groupBy("class").agg((F.sum(F.col("n") * F.abs(F.col("h") - F.col("c"))) / F.sum("n")).alias("ece")), "ece")


#: The walk over matches some of whose results became known two days later.
LATE = ELO.replace(", ev AS MATERIALIZED", ", lm AS (SELECT * REPLACE (CASE WHEN match_id % 11 = 0 THEN available_at + INTERVAL 2 DAYS ELSE available_at END AS available_at) FROM m), lev AS MATERIALIZED", 1)
for old, new in (("FROM m\n", "FROM lm\n"), ("FROM m WHERE", "FROM lm WHERE"), ("cell AS", "lcell AS"), ("FROM cell", "FROM lcell"), ("w AS (", "lw AS ("), ("w.", "lw."), ("ev.", "lev."), ("FROM w ", "FROM lw "), ("JOIN ev ", "JOIN lev "), ("elo AS (", "late AS (")):
    LATE = LATE.replace(old, new)


@query(ELO + LATE + """ SELECT league, count(*) AS n, round(avg(e), 6) AS mae, round(quantile_cont(e, 0.95), 6) AS p95, round(max(e), 6) AS largest
FROM (SELECT elo.league, abs(elo.elo_diff - late.elo_diff) AS e FROM elo JOIN late ON late.match_id = elo.match_id) GROUP BY league""")
def reconstruction_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings rebuilt with three hours from kickoff to result against stored ones, for which some results came later."""
    m = bridge.matches(spark, sf_dir)
    late = F.when(F.col("match_id") % 11 == 0, F.col("available_at") + F.expr("INTERVAL 2 DAYS")).otherwise(F.col("available_at"))
    stored = elo.elo_walk(m.withColumn("available_at", late))
    found = elo.agreement(stored.join(m.select("match_id", "league"), "match_id"), elo.elo_walk(m), ["league"])
    return rounded(found, "mae", "p95", "largest")


@query(LABELLED + ROLES + """ SELECT fold, count(*) AS n, count(DISTINCT match_id) AS distinct_ids, count(*) FILTER (WHERE role = 'train' AND kickoff_at >= b) + count(*) FILTER (WHERE role = 'validation' AND kickoff_at < b) AS misplaced FROM (
  SELECT r.*, f.b FROM roles r JOIN (VALUES """ + ", ".join(f"('{n}', TIMESTAMP '{b}')" for n, _, b, _ in FOLDS) + """) f(fold, b) ON f.fold = r.fold) GROUP BY fold""")
def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's rows, distinct ids, and rows on the wrong side of its border."""
    rows = models.split_roles(labelled(spark, sf_dir), FOLDS)
    border = F.element_at(F.create_map(*(x for n, _, b, _ in FOLDS for x in (F.lit(n), F.lit(b)))), F.col("fold")).cast("timestamp_ntz")
    late, train = F.col("kickoff_at") >= border, F.col("role") == "train"
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("match_id").alias("distinct_ids"), F.count_if((train & late) | (~train & ~late)).alias("misplaced"))


@query(FEATURES + """ SELECT count(*) - count(DISTINCT match_id) AS repeated, count(*) FILTER (WHERE home_elo_pre IS NULL OR home_form_5 IS NULL OR CASE WHEN match_id % 100 = 0 THEN NULL ELSE elo_diff END IS NULL) AS nulls, count(*) FILTER (WHERE match_id % 90 = 0) AS other_version,
  count(*) FILTER (WHERE match_id % 80 = 0) AS not_live, count(*) FILTER (WHERE match_id % 70 = 0) AS not_one_hot FROM feats WHERE status = 'finished'""")
def dataset_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What loading refuses a table for, on one with planted faults."""
    k = F.col("match_id")
    rows = features(bridge.matches(spark, sf_dir)).where("status = 'finished'")
    hot = {name: F.when(k % 70 == 0, 0).otherwise((F.col("target") == label).cast("int")) for name, label in (("home_win", "HOME"), ("draw", "DRAW"), ("away_win", "AWAY"))}
    faulty = rows.withColumns(hot | {"elo_diff": F.when(k % 100 != 0, F.col("elo_diff")), "version": F.when(k % 90 == 0, "0").otherwise("1"), "data_mode": F.when(k % 80 == 0, "mock").otherwise("live")})
    return readers.dataset_problems(faulty, ["home_elo_pre", "home_form_5", "elo_diff"], {"version": "1"})


def pit_checks(table: DataFrame, m: DataFrame) -> DataFrame:
    """(league, n, tied, future_rows, self_rows, elo_mismatches) over all rows of a built table: rows that share league
    and kickoff with another, that count more earlier matches of a side than were known, whose own result is known
    before their kickoff, and whose ratings aren't those of the walk. Counts are taken from availability times, running
    over a team's rows."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    known = (F.col("status") == "finished") & F.col("available_at").isNotNull()
    sides = m.select("match_id", micros("kickoff_at").alias("kt"), F.when(known, micros("available_at")).alias("at"), F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("home_team_id").alias("team_id")), F.struct(F.lit("away").alias("side"), F.col("away_team_id").alias("team_id")))).alias("x")).select("match_id", "kt", "at", "x.*")
    asked = sides.select("team_id", F.col("kt").alias("t"), "match_id", "side", (F.col("at") < F.col("kt")).alias("own"), F.lit(0).alias("result"))
    results = sides.where(F.col("at").isNotNull()).select("team_id", F.col("at").alias("t"), "match_id", "side", F.lit(False).alias("own"), F.lit(1).alias("result"))
    before = Window.partitionBy("team_id").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    own = F.coalesce("own", F.lit(False))
    # A match never counts itself.
    seen = asked.union(results).withColumn("seen", F.coalesce(F.sum("result").over(before), F.lit(0)) - own.cast("int")).where("result = 0")
    by_match = seen.groupBy("match_id").agg(*(F.max(F.when(F.col("side") == side, F.col("seen"))).alias(f"{side}_seen") for side in ("home", "away")), F.max(own).alias("own"))
    walked = elo.elo_walk(m).select("match_id", "home_elo", "away_elo")
    same = F.count(F.lit(1)).over(Window.partitionBy("league", "kickoff_at"))
    checked = table.withColumn("same", same).join(by_match, "match_id", "left").join(walked, "match_id", "left")
    future = (F.col("home_matches_played") > F.coalesce("home_seen", F.lit(0))) | (F.col("away_matches_played") > F.coalesce("away_seen", F.lit(0)))
    rated = F.col("home_elo_pre").eqNullSafe(F.col("home_elo")) & F.col("away_elo_pre").eqNullSafe(F.col("away_elo")) & F.col("home_elo").isNotNull()
    return checked.groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("same") > 1).alias("tied"), F.count_if(future).alias("future_rows"), F.count_if(F.col("own")).alias("self_rows"), F.count_if(~rated).alias("elo_mismatches"))


SEEN = """, asks AS (SELECT match_id, side, team_id, t, own, result, sum(result) OVER (PARTITION BY team_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
  SELECT match_id, side, team_id, CAST(epoch(kickoff_at) AS BIGINT) AS t, coalesce(available_at < kickoff_at, false) AS own, 0 AS result FROM mside UNION ALL
  SELECT match_id, side, team_id, CAST(epoch(available_at) AS BIGINT), false, 1 FROM mside WHERE available_at IS NOT NULL)),
known AS (SELECT match_id, max(before) FILTER (WHERE side = 'home') AS home_seen, max(before) FILTER (WHERE side = 'away') AS away_seen FROM (SELECT match_id, side, coalesce(before, 0) - CAST(own AS INT) AS before FROM asks WHERE result = 0) GROUP BY match_id)"""
MSIDE = ", mside AS (SELECT match_id, 'home' AS side, home_team_id AS team_id, kickoff_at, available_at FROM m UNION ALL SELECT match_id, 'away', away_team_id, kickoff_at, available_at FROM m)"


@query(FEATURES + MSIDE + SEEN + """, built AS (SELECT * REPLACE (home_elo_pre + CASE WHEN match_id % 7 = 1 THEN 1e0 ELSE 0e0 END AS home_elo_pre, away_matches_played + CASE WHEN match_id % 13 = 2 THEN 1 ELSE 0 END AS away_matches_played) FROM feats WHERE status = 'finished')
SELECT b.league, count(*) AS n, count(*) FILTER (WHERE same > 1) AS tied, count(*) FILTER (WHERE home_matches_played > home_seen OR away_matches_played > away_seen) AS future_rows,
  count(*) FILTER (WHERE m.available_at < m.kickoff_at) AS self_rows, count(*) FILTER (WHERE home_elo_pre <> home_elo OR away_elo_pre <> away_elo) AS elo_mismatches
FROM (SELECT *, count(*) OVER (PARTITION BY league, kickoff_at) AS same FROM built) b JOIN known k ON k.match_id = b.match_id JOIN elo ON elo.match_id = b.match_id JOIN m ON m.match_id = b.match_id GROUP BY b.league""")
def pit_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of pit_checks over a whole built table with planted faults: ratings that are one off, and matches that
    count one result more than was known."""
    m, k = bridge.matches(spark, sf_dir), F.col("match_id")
    faults = {"home_elo_pre": F.col("home_elo_pre") + F.when(k % 7 == 1, 1e0).otherwise(0e0), "away_matches_played": F.col("away_matches_played") + F.when(k % 13 == 2, 1).otherwise(0)}
    return pit_checks(features(m).where("status = 'finished'").withColumns(faults), m)


@query()
def pit_recheck_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the table as it is built."""
    m = bridge.matches(spark, sf_dir)
    return pit_checks(features(m).where("status = 'finished'"), m)


@query(BETS + """, pm AS (SELECT league, selection, hit, profit, sum(hit) OVER w AS island, sum(profit) OVER w AS eq FROM x WINDOW w AS (PARTITION BY league ORDER BY kickoff_at, match_id, selection ROWS UNBOUNDED PRECEDING))
SELECT a.league, n, hits, profit, CASE WHEN l = 0 THEN NULL ELSE round(g / l, 6) END AS profit_factor, longest_losing_streak, best FROM (
  SELECT league, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(sum(profit), 4) AS profit, sum(greatest(profit, 0e0)) AS g, sum(greatest(-profit, 0e0)) AS l, round(max(eq), 4) AS best FROM pm GROUP BY league) a
JOIN (SELECT league, max(lost) AS longest_losing_streak FROM (SELECT league, island, count(*) FILTER (WHERE hit = 0) AS lost FROM pm GROUP BY league, island) GROUP BY league) b ON b.league = a.league""")
def pick_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, profit factor, longest losing run and best running profit of each league, all from one window."""
    running = metrics.equity(bets(spark, sf_dir), ["league"])
    island = F.sum("hit").over(Window.partitionBy("league").orderBy(*metrics.BET_ORDER).rowsBetween(Window.unboundedPreceding, 0))
    gain, loss = F.sum(F.greatest("profit", F.lit(0e0))), F.sum(F.greatest(-F.col("profit"), F.lit(0e0)))
    runs = running.withColumn("island", island).groupBy("league", "island").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.sum("profit").alias("profit"), gain.alias("g"), loss.alias("l"), F.max("equity").alias("best"), F.count_if(F.col("hit") == 0).alias("lost")
    )
    total = runs.groupBy("league").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("profit").alias("profit"), F.sum("g").alias("g"), F.sum("l").alias("l"), F.max("lost").alias("longest_losing_streak"), F.max("best").alias("best"))
    factor = F.when(F.col("l") != 0, F.col("g") / F.nullif(F.col("l"), F.lit(0e0)))
    return total.select("league", "n", "hits", F.round("profit", 4).alias("profit"), F.round(factor, 6).alias("profit_factor"), "longest_losing_streak", F.round("best", 4).alias("best"))


@query(BETS + f", wx AS (SELECT *, CASE WHEN kickoff_at < TIMESTAMP '1996-01-01' THEN 'w1' WHEN kickoff_at < TIMESTAMP '1998-01-01' THEN 'w2' ELSE 'w3' END AS label FROM x) SELECT label, {STRATEGY} FROM wx GROUP BY GROUPING SETS ((label), ())")
def window_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategy figures of three windows and of all their picks together, ranked within the windows only."""
    label = models.period_of(F.col("kickoff_at"), [("w1", "1996-01-01"), ("w2", "1998-01-01")], "w3")
    x = bets(spark, sf_dir).withColumn("label", label)
    # Each row is offered to its window and to the total: one shuffle for both.
    both = x.withColumn("label", F.explode(F.array(F.col("label"), F.lit(None).cast("string"))))
    return tidy(metrics.strategy(both, ["label"]))


@query(BETS + """ SELECT match_id, selection, odds, outcome, hit, round(profit, 4) AS profit FROM x""")
def settled_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bets(spark, sf_dir).select("match_id", "selection", "odds", "outcome", "hit", F.round("profit", 4).alias("profit"))


@query(BETS + """, wk AS (SELECT *, CASE WHEN kickoff_at < TIMESTAMP '1996-01-01' THEN 'w1' WHEN kickoff_at < TIMESTAMP '1998-01-01' THEN 'w2' ELSE 'w3' END AS label FROM g WHERE reason IS NULL)
SELECT label, match_id, selection, window_rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, ev DESC, edge DESC, freshness DESC, match_id, selection) AS window_rank FROM wk) WHERE window_rank <= 20""")
def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best picks of each window: a top-k in every task goes before the shuffle."""
    label = models.period_of(F.col("kickoff_at"), [("w1", "1996-01-01"), ("w2", "1998-01-01")], "w3")
    eligible = value.gated(values(spark, sf_dir)).where(F.col("reason").isNull()).withColumn("label", label)
    return value.ranked(eligible, ["label"], "window_rank").where("window_rank <= 20").select("label", "match_id", "selection", "window_rank")


ORDERED = ("3-MEDIUM", "1-URGENT")


@query("SELECT league, count(*) AS n, CASE league WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 2 + row_number() OVER (ORDER BY league IN ('3-MEDIUM', '1-URGENT'), league) END AS place FROM m GROUP BY league")
def ordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in a fixed order, then the others by name. The window ranges over one row a league."""
    counted = bridge.matches(spark, sf_dir).groupBy("league").agg(F.count(F.lit(1)).alias("n"))
    fixed = F.array_position(F.array(*map(F.lit, ORDERED)), F.col("league"))
    others = F.row_number().over(Window.orderBy(fixed != 0, "league")) + len(ORDERED)
    return counted.withColumn("place", F.when(fixed != 0, fixed.cast("int")).otherwise(others))


@query("SELECT p.match_id, replace(printf('%.1f', round_even(p_home * 100, 1)), '.', ',') || ' %' AS home, replace(printf('%.1f', round_even(p_draw * 100, 1)), '.', ',') || ' %' AS draw FROM p")
def shown_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities as text: percents with a decimal comma, rounded half to even."""
    p = bridge.predictions(bridge.matches(spark, sf_dir))
    return p.select("match_id", X.percent(F.col("p_home")).alias("home"), X.percent(F.col("p_draw")).alias("draw"))


@query(POISSON + f""", gr AS (SELECT 0.9e0 + 0.025e0 * i AS advantage FROM range(19) r(i)), lt AS (SELECT lam.* FROM lam JOIN tr ON tr.match_id = lam.match_id),
gs AS (SELECT match_id, advantage, any_value(target) AS y, sum(pr) FILTER (WHERE i > j) AS h, sum(pr) FILTER (WHERE i = j) AS dd, sum(pr) FILTER (WHERE i < j) AS aa FROM (
  SELECT match_id, advantage, target, x.i AS i, y.i AS j, exp(-lh * advantage) * pow(lh * advantage, x.i) / [{FACTORIALS}][x.i + 1] * exp(-la) * pow(la, y.i) / [{FACTORIALS}][y.i + 1] AS pr FROM lt, gr, range(11) x(i), range(11) y(i)) GROUP BY match_id, advantage),
ls AS (SELECT advantage, avg(-ln(greatest(CASE y WHEN 'HOME' THEN h WHEN 'DRAW' THEN dd ELSE aa END / (h + dd + aa), 1e-15))) AS loss FROM gs GROUP BY advantage)
SELECT round(advantage, 6) AS advantage, round(loss, 8) AS log_loss, row_number() OVER (ORDER BY round(loss, 8), advantage) = 1 AS chosen FROM ls""")
def advantage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-loss of nineteen factors on the home side's goal rate, the first smallest marked, in one pass: every row is
    offered to all cells and summed before the shuffle. The window ranges over one row a cell."""
    rows = written(features(bridge.matches(spark, sf_dir)).where("status = 'finished'"))
    train = rows.where(F.col("kickoff_at") < F.lit(TRAIN_END).cast("timestamp_ntz"))
    rates = models.goal_rates(train, models.mean_goal_rates(train))
    grid = models.advantage_losses(rates, [0.9 + 0.025 * i for i in range(19)])
    shown = grid.select(F.round("advantage", 6).alias("advantage"), F.round("log_loss", 8).alias("log_loss"))
    return shown.withColumn("chosen", F.row_number().over(Window.orderBy("log_loss", "advantage")) == 1)


#: (plan, period, start, end): the frozen periods, and a plan with a gap and an overlap.
PLANS = [("frozen", n, a, b) for (n, b), a in zip([*PERIODS, ("final_test", "2100-01-01")], ["1900-01-01", *(end for _, end in PERIODS)])]
PLANS += [("faulty", "train", "1900-01-01", TRAIN_END), ("faulty", "calibration_fit", "1999-03-01", "2000-03-01"), ("faulty", "calibration_select", PERIODS[1][1], PERIODS[2][1]), ("faulty", "final_test", PERIODS[2][1], "2100-01-01")]
PLAN_SQL = ", ".join(f"('{p}', '{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for p, n, a, b in PLANS)


@query(LABELLED + f""", pl AS (SELECT * FROM (VALUES {PLAN_SQL}) v(plan, period, a, b)),
hits AS (SELECT plan, match_id, count(period) AS n FROM (SELECT p.plan, q.match_id, pl.period FROM q CROSS JOIN (SELECT DISTINCT plan FROM pl) p LEFT JOIN pl ON pl.plan = p.plan AND kickoff_at >= a AND kickoff_at < b) GROUP BY plan, match_id)
SELECT plan, count(*) AS rows_in, count(*) FILTER (WHERE n > 0) AS covered, count(*) FILTER (WHERE n > 1) AS shared, count(*) FILTER (WHERE n <> 1) = 0 AS disjoint_cover FROM hits GROUP BY plan""")
def period_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the periods of each plan cover all rows, and share none: the frozen plan, and one with faults."""
    rows, out = labelled(spark, sf_dir), None
    for plan in ("frozen", "faulty"):
        one = models.disjoint_cover(rows, [(n, a, b) for p, n, a, b in PLANS if p == plan]).withColumn("plan", F.lit(plan))
        out = one if out is None else out.union(one)
    return out
