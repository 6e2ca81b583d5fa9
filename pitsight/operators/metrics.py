"""Classification, calibration and betting metrics."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import odds as O
from ..session import written

CLASSES = ("HOME", "DRAW", "AWAY")
BINS = 10
#: Bin edges as the reference for comparisons has them: multiples of a tenth in double arithmetic.
EDGES = [i * 0.1 for i in range(BINS)] + [1.0]
CLIP = 1e-15


def labelled(matches: DataFrame, predictions: DataFrame) -> DataFrame:
    """Finished matches with outcome y, probabilities, the predicted class and the largest probability."""
    y = O.outcome(F.col("home_score"), F.col("away_score"))
    p = [F.col(c) for c in ("p_home", "p_draw", "p_away")]
    return (
        matches.where("status = 'finished'").select("match_id", "league", "season", "kickoff_at", y.alias("y")).join(predictions, "match_id")
        .withColumns({"predicted": O.argmax_1x2(*p), "confidence": F.greatest(*p), "p_y": O.probability_of(F.col("y"), *p)})
    )


def class_metrics_columns() -> list[Column]:
    """Aggregates: rows, log-loss, multiclass Brier score and accuracy."""
    brier = sum(((F.col(c) - (F.col("y") == s).cast("double")) * (F.col(c) - (F.col("y") == s).cast("double")) for c, s in zip(("p_home", "p_draw", "p_away"), CLASSES)), F.lit(0e0))
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(-F.log(F.greatest(F.col("p_y"), F.lit(CLIP)))).alias("log_loss"),
        F.avg(brier).alias("brier"),
        F.avg((F.col("predicted") == F.col("y")).cast("double")).alias("accuracy"),
    ]


def class_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(*class_metrics_columns())


def per_class(rows: DataFrame) -> DataFrame:
    """Support, precision, recall, mean probability, one-against-rest log-loss and Brier score of each class."""
    three = F.explode(F.array(*(F.struct(F.lit(s).alias("class"), F.col(c).alias("p")) for s, c in zip(CLASSES, ("p_home", "p_draw", "p_away")))))
    long = rows.select("y", "predicted", three.alias("c")).select("y", "predicted", "c.*")
    own, said = F.col("y") == F.col("class"), F.col("predicted") == F.col("class")
    held = F.least(F.greatest("p", F.lit(CLIP)), F.lit(1 - CLIP))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0e0))
    both = F.count_if(own & said)
    return long.groupBy("class").agg(
        F.count_if(own).alias("support"), ratio(both, F.count_if(said)).alias("precision"), ratio(both, F.count_if(own)).alias("recall"), F.avg("p").alias("mean_p"),
        F.avg(F.when(own, -F.log(held)).otherwise(-F.log(F.lit(1e0) - held))).alias("log_loss"), F.avg((F.col("p") - own.cast("double")) * (F.col("p") - own.cast("double"))).alias("brier"),
    )


def bin_of(p: Column) -> Column:
    """Number of the bin [l, r) of p, 0 to 9; the last one holds 1 too."""
    out = F.when(p >= EDGES[BINS - 1], BINS - 1)
    for i in range(BINS - 2, 0, -1):
        out = out.when(p >= EDGES[i], i)
    return out.otherwise(0)


def reliability(rows: DataFrame, p: Column, hit: Column) -> DataFrame:
    """(bin, n, mean_p, hit_rate) for all ten bins, empty ones with zeros."""
    counted = rows.groupBy(bin_of(p).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(hit.cast("double")).alias("hit_rate"))
    bins = rows.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_p", F.lit(0e0)).alias("mean_p"), F.coalesce("hit_rate", F.lit(0e0)).alias("hit_rate"))


def expected_calibration_error(rows: DataFrame) -> DataFrame:
    """Weighted mean distance of confidence and accuracy over the bins."""
    binned = reliability(rows, F.col("confidence"), F.col("predicted") == F.col("y"))
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("hit_rate") - F.col("mean_p"))) / F.greatest(F.sum("n"), F.lit(1))).alias("ece"), F.sum("n").alias("n"))


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of all nine cells, zeros included."""
    cells = rows.sparkSession.createDataFrame([(a, b) for a in CLASSES for b in CLASSES], "y string, predicted string")
    return cells.join(rows.groupBy("y", "predicted").count(), ["y", "predicted"], "left").select("y", "predicted", F.coalesce("count", F.lit(0)).alias("n"))


def strategy(bets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bets, hits, rates, mean odds, edge and EV, profit, return on stake, counts by selection, sample flags."""
    n = F.count(F.lit(1))
    return bets.groupBy(*(by or [])).agg(
        n.alias("n"), F.sum("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("odds").alias("avg_odds"), F.avg("edge").alias("avg_edge"), F.avg("ev").alias("avg_ev"),
        F.sum("profit").alias("profit"), (F.sum("profit") / n).alias("roi"), *(F.count_if(F.col("selection") == s).alias(s.lower()) for s in CLASSES), (n < 30).alias("small_sample"), (n >= 250).alias("robust"),
    )


def profit_factor(bets: DataFrame, by: list[str]) -> DataFrame:
    """Gains over losses: null without either, infinite without losses."""
    gains, losses = F.sum(F.greatest("profit", F.lit(0e0))), F.sum(F.greatest(-F.col("profit"), F.lit(0e0)))
    return bets.groupBy(*by).agg(F.when((losses == 0) & (gains == 0), None).when(losses == 0, F.lit(float("inf"))).otherwise(gains / F.nullif(losses, F.lit(0e0))).alias("profit_factor"))


BET_ORDER = ["kickoff_at", "match_id", "selection"]


def equity(bets: DataFrame, by: list[str]) -> DataFrame:
    """Bets with running profit and drawdown from the highest profit so far, which starts at zero."""
    w = Window.partitionBy(*by).orderBy(*BET_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    running = bets.withColumn("equity", F.sum("profit").over(w))
    return running.withColumn("drawdown", F.greatest(F.max("equity").over(w), F.lit(0e0)) - F.col("equity"))


def losing_streaks(bets: DataFrame, by: list[str]) -> DataFrame:
    """Longest run of lost bets: rows between two hits share the number of hits before them."""
    island = F.sum("hit").over(Window.partitionBy(*by).orderBy(*BET_ORDER).rowsBetween(Window.unboundedPreceding, 0))
    runs = bets.withColumn("island", island).groupBy(*by, "island").agg(F.count_if(F.col("hit") == 0).alias("lost"))
    return runs.groupBy(*by).agg(F.max("lost").alias("longest_losing_streak"))


def buckets(rows: DataFrame, column: str, bins: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """(label, n, hits, profit) by half-open bins; all labels appear, values outside of every bin count nowhere."""
    value = F.col(column)
    label = None
    for name, low, high in bins:
        inside = (value >= low if low is not None else F.lit(True)) & (value < high if high is not None else F.lit(True))
        label = F.when(inside, name) if label is None else label.when(inside, name)
    counted = rows.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.sum("profit").alias("profit"))
    names = rows.sparkSession.createDataFrame([(b[0],) for b in bins], "label string")
    return names.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("profit", F.lit(0e0)).alias("profit"))


def fingerprints(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, n, fingerprint): the sum of the rows' hashes (60 bits of SHA-256 over the columns as text) in each group. It
    doesn't depend on the order of rows, and repeats count."""
    one = F.conv(F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(one).cast("decimal(38,0)").cast("string").alias("fingerprint"))


def exact_percentiles(rows: DataFrame, x: str, shares: dict[str, float], by: list[str] | None = None, digits: int = 1) -> DataFrame:
    """(by, a column a share): exact percentiles of x between its two nearest ranks, as percentile() gives them, which
    holds all distinct values of a group in one task. Here values are counted by x rounded down to some digits; only the
    values of the bins that hold a wanted rank are ordered. Rows of a group without any x are left out."""
    by = by or []
    values = written(rows.select(*by, F.col(x).alias("_x")).where(F.col("_x").isNotNull()).groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n")).withColumn("_bin", F.floor(F.col("_x") * 10**digits)))
    bins = values.groupBy(*by, "_bin").agg(F.sum("_n").alias("_m"))
    before, all_ = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    bins = bins.withColumns({"_before": F.coalesce(F.sum("_m").over(before), F.lit(0)), "_all": F.sum("_m").over(all_)})
    ranks = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("_all") - 1) * F.lit(float(share))).alias("at")) for name, share in shares.items())))
    wanted = bins.withColumn("_s", ranks).where((F.floor("_s.at") < F.col("_before") + F.col("_m")) & (F.ceil("_s.at") >= F.col("_before"))).select(*by, "_bin", "_before", "_s.name", "_s.at")
    wanted = wanted.withColumnsRenamed({c: f"_{c}" for c in by}).withColumnRenamed("_bin", "_in")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.col("_bin") == F.col("_in"))
    inside = values.join(F.broadcast(wanted), same)
    upto = F.sum("_n").over(Window.partitionBy(*by, "_bin", "name").orderBy("_x")) + F.col("_before")
    ranked = inside.withColumn("_end", upto)
    holds = lambda rank: (F.col("_end") > rank) & (F.col("_end") - F.col("_n") <= rank)
    ends = ranked.groupBy(*by, "name").agg(F.first("at").alias("at"), F.max(F.when(holds(F.floor("at")), F.col("_x"))).alias("low"), F.max(F.when(holds(F.ceil("at")), F.col("_x"))).alias("high"))
    between = F.when(F.ceil("at") == F.floor("at"), F.col("low")).otherwise((F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high"))
    return ends.withColumn("value", between).groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in shares))
