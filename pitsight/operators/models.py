"""Temporal splits, closed-form and fitted models, calibration and ensembles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import odds as O
from ..session import written

CLASSES = ("HOME", "DRAW", "AWAY")
#: Partitions that training rows of sampled models are dealt into.
FIT_PARTITIONS = 16


def split_roles(rows: DataFrame, folds: list[tuple[str, str, str, str]], at: str = "kickoff_at") -> DataFrame:
    """rows once for each fold that they belong to, with fold and role train or validation.

    folds: (name, train start, validation start, validation end), half open. The bounds are literals, so a row's folds
    come from comparisons, not from a join."""
    time = lambda s: F.lit(s).cast("timestamp_ntz")
    roles = [
        F.when((F.col(at) >= time(a)) & (F.col(at) < time(b)), F.struct(F.lit(name).alias("fold"), F.lit("train").alias("role")))
        .when((F.col(at) >= time(b)) & (F.col(at) < time(c)), F.struct(F.lit(name).alias("fold"), F.lit("validation").alias("role")))
        for name, a, b, c in folds
    ]
    return rows.withColumn("in", F.explode(F.array_compact(F.array(*roles)))).select(*rows.columns, "in.fold", "in.role")


def period_of(at: Column, bounds: list[tuple[str, str]], last: str) -> Column:
    """Name of the first period whose end (exclusive) lies after a time; last after all of them."""
    out = None
    for name, end in bounds:
        before = at < F.lit(end).cast("timestamp_ntz")
        out = F.when(before, name) if out is None else out.when(before, name)
    return out.otherwise(last)


def disjoint_cover(rows: DataFrame, periods: list[tuple[str, str, str]], at: str = "kickoff_at") -> DataFrame:
    """(rows_in, covered, shared, disjoint_cover): rows, those inside of some half-open period, those inside of several,
    and whether every row is in exactly one. Bounds are literals: one pass without a join."""
    time = lambda s: F.lit(s).cast("timestamp_ntz")
    hits = sum(((F.col(at) >= time(a)) & (F.col(at) < time(b))).cast("int") for _, a, b in periods)
    return rows.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(hits > 0).alias("covered"), F.count_if(hits > 1).alias("shared"), (F.count_if(hits != 1) == 0).alias("disjoint_cover"))


def class_frequencies(train: DataFrame, y: str = "y", by: list[str] | None = None) -> DataFrame:
    shares = [F.avg((F.col(y) == c).cast("double")).alias(f"p_{c.lower()}") for c in CLASSES]
    return train.groupBy(*(by or [])).agg(*shares, F.count(F.lit(1)).alias("n"))


def goal_rates(form: DataFrame, means: DataFrame) -> DataFrame:
    """(lambda_home, lambda_away) from goals over the last five matches: half of attack plus the other side's defence,
    held within [0.2, 4.5]; a side without a full window uses the training means (one row, sent to all)."""
    rows = form.crossJoin(F.broadcast(means))
    part = lambda side, kind: F.when(F.col(f"{side}_form_5_available") == 1, F.col(f"{side}_goals_{kind}_5") / 5e0).otherwise(F.col(f"mean_{side}_{kind}"))
    held = lambda c: F.least(F.greatest(c, F.lit(0.2)), F.lit(4.5))
    return rows.withColumns({"lambda_home": held((part("home", "for") + part("away", "against")) * 0.5), "lambda_away": held((part("away", "for") + part("home", "against")) * 0.5)})


def mean_goal_rates(form: DataFrame) -> DataFrame:
    """Mean goals a match by side and kind over rows with a full window, 1.3 without any."""
    mean = lambda side, kind: F.coalesce(F.avg(F.when(F.col(f"{side}_form_5_available") == 1, F.col(f"{side}_goals_{kind}_5") / 5e0)), F.lit(1.3)).alias(f"mean_{side}_{kind}")
    return form.agg(*(mean(s, k) for s in ("home", "away") for k in ("for", "against")))


def log_loss_of(y: Column, home: Column, draw: Column, away: Column) -> Column:
    return -F.log(F.greatest(O.probability_of(y, home, draw, away), F.lit(O.CLIP)))


def advantage_losses(rates: DataFrame, factors: list[float], y: str = "target") -> DataFrame:
    """(advantage, log_loss) of the Poisson model with the home side's rate times each factor. Rates come from sums of a
    few goals: the model is evaluated once for equal rates and outcomes, weighed by their number."""
    counted = rates.groupBy(y, "lambda_home", "lambda_away").agg(F.count(F.lit(1)).alias("n"))
    each = counted.select(y, "lambda_home", "lambda_away", "n", F.explode(F.array(*map(F.lit, factors))).alias("advantage"))
    p = O.poisson_1x2(F.col("lambda_home") * F.col("advantage"), F.col("lambda_away"))
    losses = each.select("advantage", "n", log_loss_of(F.col(y), *p).alias("loss")).where(F.col("loss").isNotNull())
    return losses.groupBy("advantage").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("log_loss"))


def provenance(cards: DataFrame, rows: DataFrame, frozen: dict[str, str], at: str = "kickoff_at") -> DataFrame:
    """(model_version, check_name, ok): each registered card against the frozen protocol and the rows that it names.

    cards: (model_version, status, selected_model, train_end, select_end, test_start, train_rows, select_rows, test_rows).
    The period ends must be the frozen ones, the selection must end where the test starts, the status and model must be
    the frozen ones, and each number of rows must be positive and that of the table. Cards are few: rows are counted once
    for all of them."""
    time = lambda c: F.col(c).cast("timestamp_ntz")
    inside = {"train": F.col(at) < time("train_end"), "select": (F.col(at) >= time("train_end")) & (F.col(at) < time("select_end")), "test": F.col(at) >= time("test_start")}
    counted = rows.select(at).crossJoin(F.broadcast(cards)).groupBy("model_version").agg(*(F.count_if(c).alias(f"{n}_counted") for n, c in inside.items()))
    joined = cards.join(counted, "model_version", "left")
    checks = {c: F.col(c) == F.lit(frozen[c]) for c in ("status", "selected_model", "train_end", "select_end", "test_start")}
    checks["select_ends_at_test"] = F.col("select_end") == F.col("test_start")
    for n in inside:
        checks[f"{n}_rows"] = (F.col(f"{n}_rows") > 0) & (F.col(f"{n}_rows") == F.coalesce(f"{n}_counted", F.lit(0)))
    listed = F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in checks.items())))
    return joined.select("model_version", listed.alias("x")).select("model_version", "x.*")


def draw_transform_grid(rows: DataFrame, bases: list[float], decays: list[float]) -> DataFrame:
    """Mean log-loss of the rating model for every pair of draw parameters: rows are first summed up by rating
    difference and outcome, so that the grid meets a bounded number of groups rather than every match."""
    grouped = rows.groupBy(F.bround("elo_diff").alias("diff"), "y").agg(F.count(F.lit(1)).alias("n"))
    cells = F.explode(F.array(*(F.struct(F.lit(b).alias("draw_base"), F.lit(d).alias("draw_decay")) for b in bases for d in decays)))
    each = grouped.withColumn("cell", cells).select("diff", "y", "n", "cell.*")
    expected = F.lit(1e0) / (F.lit(1e0) + F.pow(F.lit(1e1), -((F.col("diff") + O.HOME_ADVANTAGE) / O.SCALE)))
    draw = F.least(F.greatest(F.col("draw_base") * F.exp(-F.col("draw_decay") * F.abs("diff") / O.SCALE), F.lit(O.DRAW_LOW)), F.lit(O.DRAW_HIGH))
    p = O.clipped((F.lit(1e0) - draw) * expected, draw, (F.lit(1e0) - draw) * (F.lit(1e0) - expected))
    return each.groupBy("draw_base", "draw_decay").agg((F.sum(log_loss_of(F.col("y"), *p) * F.col("n")) / F.sum("n")).alias("log_loss"))


#: Start and bounds of the draw transform's two parameters.
DRAW_START, DRAW_BOUNDS = (0.26, 0.8), ((0.12, 0.40), (0.0, 4.0))
#: Step lengths that a search along a direction looks at together.
STEPS = tuple(2.0**-i for i in range(12))


def draw_bins(rows: DataFrame) -> DataFrame:
    """(u, n, n_draw): matches by rating difference in whole points as a share of the scale, whatever its sign: all that
    the draw probability's likelihood depends on, in as many rows as there are differences."""
    u = F.abs(F.bround("elo_diff")) / O.SCALE
    return rows.groupBy(u.alias("u")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == "DRAW").alias("n_draw"))


def draw_derivatives(bins: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    """(point, loss, g_base, g_decay, h_base, h_both, h_decay) for each pair of parameters: the mean log-loss of draw
    against no draw, its gradient, and its expected curvature. One aggregation over the bins for all points; where the
    draw probability is held at its limits it has no slope."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("point"), F.lit(float(b)).alias("base"), F.lit(float(d)).alias("decay")) for i, (b, d) in enumerate(points))))
    free = F.col("base") * F.exp(-F.col("decay") * F.col("u"))
    each = bins.withColumn("cell", cells).select("u", "n", "n_draw", "cell.*").withColumn("p", F.least(F.greatest(free, F.lit(O.DRAW_LOW)), F.lit(O.DRAW_HIGH))).withColumn("inside", (free > O.DRAW_LOW) & (free < O.DRAW_HIGH))
    p, n, k = F.col("p"), F.col("n"), F.col("n_draw")
    slope = F.when(F.col("inside"), (n - k) / (1 - p) - k / p).otherwise(0e0)
    weight = F.when(F.col("inside"), n / (p * (1 - p))).otherwise(0e0)
    by_base, by_decay = F.exp(-F.col("decay") * F.col("u")), -F.col("u") * p
    mean = lambda x, name: (F.sum(x) / F.sum("n")).alias(name)
    return each.groupBy("point").agg(
        mean(-k * F.log(p) - (n - k) * F.log(1 - p), "loss"), mean(slope * by_base, "g_base"), mean(slope * by_decay, "g_decay"), mean(weight * by_base * by_base, "h_base"), mean(weight * by_base * by_decay, "h_both"), mean(weight * by_decay * by_decay, "h_decay"),
    )


def fitted_draw_transform(rows: DataFrame, rounds: int = 40, tolerance: float = 1e-10) -> dict[str, float]:
    """draw_base and draw_decay with the least log-loss within their bounds, by projected Newton steps: a parameter at a
    bound that its gradient points beyond is held there, the others take a step by the expected curvature, cut short so
    that the loss falls. rows: (elo_diff, y). Only a few sums a round reach the driver; the bins are written once."""
    bins = written(draw_bins(rows))
    x = list(DRAW_START)
    now = draw_derivatives(bins, [tuple(x)]).first()
    if now is None:
        return {"draw_base": x[0], "draw_decay": x[1], "log_loss": 0.0, "rounds": 0}
    for turn in range(rounds):
        g, h = [now["g_base"], now["g_decay"]], [[now["h_base"], now["h_both"]], [now["h_both"], now["h_decay"]]]
        held = [x[i] <= DRAW_BOUNDS[i][0] and g[i] > 0 or x[i] >= DRAW_BOUNDS[i][1] and g[i] < 0 for i in range(2)]
        steps = _newton(g, h, held)
        if max(abs(s) for s in steps) < tolerance:
            break
        tried = [tuple(min(max(x[i] - t * steps[i], DRAW_BOUNDS[i][0]), DRAW_BOUNDS[i][1]) for i in range(2)) for t in STEPS]
        found = {r["point"]: r for r in draw_derivatives(bins, tried).collect()}
        best = min(found, key=lambda i: (found[i]["loss"], i))
        if found[best]["loss"] >= now["loss"] - 1e-15:
            break
        x, now = list(tried[best]), found[best]
    return {"draw_base": x[0], "draw_decay": x[1], "log_loss": now["loss"], "g_base": now["g_base"], "g_decay": now["g_decay"], "rounds": turn + 1}


def _newton(g: list[float], h: list[list[float]], held: list[bool]) -> list[float]:
    """The step of the parameters that aren't held: by the curvature of these alone, by the slope where there is none."""
    if all(held):
        return [0.0, 0.0]
    if any(held):
        i = held.index(False)
        out = [0.0, 0.0]
        out[i] = g[i] / h[i][i] if h[i][i] > 1e-12 else g[i]
        return out
    det = h[0][0] * h[1][1] - h[0][1] * h[1][0]
    if det <= 1e-14 * max(h[0][0] * h[1][1], 1e-300):
        return [g[i] / h[i][i] if h[i][i] > 1e-12 else g[i] for i in range(2)]
    return [(h[1][1] * g[0] - h[0][1] * g[1]) / det, (h[0][0] * g[1] - h[1][0] * g[0]) / det]


def ensemble_weights(losses: DataFrame) -> DataFrame:
    """Weights in proportion to 1 / log-loss, one row a model."""
    inverse = F.lit(1e0) / F.col("log_loss")
    return losses.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy()))


def mixture(members: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean probability of each match over the models."""
    joined = members.join(F.broadcast(weights.select("model", "weight")), "model")
    return joined.groupBy("match_id").agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("p_home", "p_draw", "p_away")))


def sigmoid_calibrated(fit: DataFrame, rows: DataFrame) -> DataFrame:
    """Platt scaling of each class against the rest by logistic regression, then scaled to a sum of one. Equal
    probabilities with equal outcomes are one row to a fit, weighed by their number."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    out = rows
    for c in CLASSES:
        column = f"p_{c.lower()}"
        assemble = VectorAssembler(inputCols=[column], outputCol="x")
        counted = fit.groupBy(column, (F.col("y") == c).cast("double").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-4, standardization=False, weightCol="n", probabilityCol="pr", rawPredictionCol="raw", predictionCol="pred").fit(assemble.transform(counted))
        out = model.transform(assemble.transform(out)).withColumn(f"c_{c.lower()}", vector_to_array("pr")[1]).drop("x", "pr", "raw", "pred")
    p = O.clipped(F.col("c_home"), F.col("c_draw"), F.col("c_away"))
    return out.withColumns({"c_home": p[0], "c_draw": p[1], "c_away": p[2]})


#: Digits of a probability that bins of an isotonic fit keep: a fit sees a thousand bins however many rows there are.
BIN_DIGITS = 3


def calibration_bins(fit: DataFrame, digits: int = BIN_DIGITS) -> DataFrame:
    """(class, x, n, hits): rows and rows of the class by its rounded probability, for all classes in one pass."""
    each = F.array(*(F.struct(F.lit(c).alias("class"), F.bround(f"p_{c.lower()}", digits).alias("x"), (F.col("y") == c).alias("hit")) for c in CLASSES))
    return fit.select(F.explode(each).alias("e")).select("e.*").groupBy("class", "x").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


def pooled(bins: list[tuple[float, int, int]]) -> list[tuple[float, int, float]]:
    """(x, n, value): the non-decreasing values that are nearest to the bins' (x, n, hits) rates, weighed by n: a stack of
    blocks, of which the last two are pooled for as long as their rates fall."""
    stack: list[list] = []
    for x, n, hits in sorted(bins):
        stack.append([n, hits, [(x, n)]])
        while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
            last = stack.pop()
            stack[-1] = [stack[-1][0] + last[0], stack[-1][1] + last[1], stack[-1][2] + last[2]]
    return [(x, n, hits / total) for total, hits, members in stack for x, n in members]


def isotonic_points(fit: DataFrame) -> dict[str, list[tuple[float, int, float]]]:
    """The fitted values of each class at its bins. At most a thousand and one rows a class reach the driver."""
    found: dict[str, list] = {c: [] for c in CLASSES}
    for r in calibration_bins(fit).where(F.col("x").isNotNull()).collect():
        found[r["class"]].append((r["x"], r["n"], r["hits"]))
    return {c: pooled(bins) for c, bins in found.items()}


def isotonic_calibrated(fit: DataFrame, rows: DataFrame, least_rows: int = 200, least_class: int = 30) -> DataFrame | None:
    """Isotonic regression of each class against the rest, between bins a straight line, scaled to a sum of one; None
    where the fit has too few rows in all or of a class."""
    counts = {r["y"]: r["n"] for r in fit.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(counts.values()) < least_rows or min(counts.get(c, 0) for c in CLASSES) < least_class:
        return None
    points, out = isotonic_points(fit), rows
    for c in CLASSES:
        out = out.withColumn(f"c_{c.lower()}", _between(F.col(f"p_{c.lower()}"), [(x, v) for x, _, v in points[c]]))
    p = O.clipped(F.col("c_home"), F.col("c_draw"), F.col("c_away"))
    return out.withColumns({"c_home": p[0], "c_draw": p[1], "c_away": p[2]})


def _between(x: Column, points: list[tuple[float, float]]) -> Column:
    """The value at x on the straight lines between points, that of the end beyond them."""
    xs, values = [p[0] for p in points], [p[1] for p in points]

    @F.pandas_udf("double")
    def at(column: pd.Series) -> pd.Series:
        return pd.Series(np.interp(column.to_numpy(), xs, values))

    return at(x)


#: Calibrations by name: (fit, rows) to rows with c_home, c_draw and c_away, or None where there is too little to fit.
CALIBRATIONS = {
    "raw": lambda fit, rows: rows.withColumns({f"c_{c.lower()}": F.col(f"p_{c.lower()}") for c in CLASSES}), "sigmoid": lambda fit, rows: sigmoid_calibrated(fit, rows), "isotonic": lambda fit, rows: isotonic_calibrated(fit, rows),
}


def calibration_losses(fit: DataFrame, held: DataFrame) -> DataFrame:
    """(method, log_loss, n): every calibration that can be fitted, on the held rows."""
    out = None
    for name, calibrate in CALIBRATIONS.items():
        rows = calibrate(fit, held)
        if rows is None:
            continue
        one = rows.agg(F.avg(log_loss_of(F.col("y"), F.col("c_home"), F.col("c_draw"), F.col("c_away"))).alias("log_loss"), F.count(F.lit(1)).alias("n")).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def calibrated_finally(fit: DataFrame, select: DataFrame, rows: DataFrame) -> tuple[str, DataFrame]:
    """The calibration with the least loss on the selection period (of equal ones the first), fitted anew on both
    periods and applied to rows."""
    losses = {r["method"]: r["log_loss"] for r in calibration_losses(fit, select).collect()}
    chosen = min(losses, key=lambda name: (losses[name], list(CALIBRATIONS).index(name)))
    return chosen, CALIBRATIONS[chosen](fit.unionByName(select), rows)


def boosted_trees(train: DataFrame, rows: DataFrame, features: list[str], rounds: int = 10, depth: int = 4) -> DataFrame:
    """Gradient-boosted trees, one class against the rest, scaled to a sum of one: MLlib's in place of other libraries'.

    Rows are sampled by partition and place, so training rows are dealt and ordered by match_id first: reruns agree
    whatever the shuffles before."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assemble = VectorAssembler(inputCols=features, outputCol="x")
    dealt = train.repartition(FIT_PARTITIONS, "match_id").sortWithinPartitions("match_id")
    fit, out = assemble.transform(dealt).select("x", "y").persist(), assemble.transform(rows)
    for c in CLASSES:
        model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=42).fit(fit.withColumn("label", (F.col("y") == c).cast("double")))
        out = model.transform(out).withColumn(f"p_{c.lower()}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    fit.unpersist()
    p = O.clipped(F.col("p_home"), F.col("p_draw"), F.col("p_away"))
    return out.drop("x").withColumns({"p_home": p[0], "p_draw": p[1], "p_away": p[2]})
