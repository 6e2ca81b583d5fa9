"""Pooled values against the largest smallest mean; choice and refit of a calibration."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitsight.operators import models


def largest_smallest_mean(bins):
    bins = sorted(bins)
    mean = lambda j, k: sum(b[2] for b in bins[j : k + 1]) / sum(b[1] for b in bins[j : k + 1])
    n = len(bins)
    return [(bins[i][0], bins[i][1], max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1))) for i in range(n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 9)), max_size=9))
def test_pooled_values(counts):
    bins = [(i / 10, n, min(n, k)) for i, (n, k) in enumerate(counts)]
    got = models.pooled(bins[::-1])
    assert [g[:2] for g in got] == [b[:2] for b in bins]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in largest_smallest_mean(bins)])


def drawn(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        h = r.uniform(0.1, 0.8)
        d = r.uniform(0.05, 0.9 - h)
        # True chances are the squares, scaled: the given ones have to be bent.
        w = [h * h, d * d, (1 - h - d) ** 2]
        rows.append((i, r.choices(models.CLASSES, w)[0], h, d, 1 - h - d))
    return rows


def test_the_best_calibration_is_chosen_and_fitted_on_both_periods(spark):
    frames = [spark.createDataFrame(drawn(1500, s), "match_id long, y string, p_home double, p_draw double, p_away double") for s in (1, 2, 3)]
    losses = {r["method"]: r["log_loss"] for r in models.calibration_losses(frames[0], frames[1]).collect()}
    assert set(losses) == {"raw", "sigmoid", "isotonic"} and losses["raw"] > min(losses.values())
    chosen, rows = models.calibrated_finally(*frames)
    assert losses[chosen] == min(losses.values())
    shown = rows.agg(*(F.avg(models.log_loss_of(F.col("y"), *(F.col(f"{p}_{c}") for c in ("home", "draw", "away")))).alias(p) for p in ("p", "c"))).first()
    assert shown["c"] < shown["p"]
    sums = rows.select((F.col("c_home") + F.col("c_draw") + F.col("c_away")).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert tuple(sums) == pytest.approx((1.0, 1.0))
    both = models.isotonic_points(frames[0].unionByName(frames[1]))
    assert sum(n for _, n, _ in both["HOME"]) == 3000
    assert models.isotonic_calibrated(frames[0].limit(100), frames[1]) is None


def test_fits_read_written_rows(spark):
    from pitsight.plans import modelling

    rows = modelling.periods(spark, "/root/testdata/sf0.001")["calibration_fit"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and rows.count()


def test_advantage_losses_meet_equal_rates_once(spark):
    from pitsight.functions import odds as O
    from pitsight.operators import models
    from pyspark.sql import functions as F

    rates = spark.createDataFrame([("HOME", 1.2, 0.8)] * 5 + [("DRAW", 1.2, 0.8), ("AWAY", 0.4, 2.0)], "target string, lambda_home double, lambda_away double")
    found = models.advantage_losses(rates, [1.0, 1.25])
    for r in found.collect():
        p = O.poisson_1x2(F.col("lambda_home") * r["advantage"], F.col("lambda_away"))
        assert abs(rates.agg(F.avg(models.log_loss_of(F.col("target"), *p))).first()[0] - r["log_loss"]) < 1e-12
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate explode"):]
