"""The bounded draw fit against a fine grid, with optima inside, at and beyond the bounds."""

import math
import random

import pytest

from pitsight.operators import models


def loss(bins, base, decay):
    total = sum(n for _, n, _ in bins)
    out = 0.0
    for u, n, k in bins:
        p = min(max(base * math.exp(-decay * u), 0.05), 0.42)
        out -= k * math.log(p) + (n - k) * math.log(1 - p)
    return out / total


@pytest.mark.parametrize(("base", "decay"), [(0.3, 0.9), (0.6, 0.2), (0.06, 0.1), (0.39, 6.0), (0.3, -1.0)])
def test_the_fit_is_no_worse_than_a_grid(spark, base, decay):
    r = random.Random(7)
    rows = []
    for _ in range(6000):
        diff = r.gauss(0, 250)
        draw = r.random() < min(max(base * math.exp(-decay * abs(diff) / 400), 0.0), 0.9)
        rows.append((diff, "DRAW" if draw else "HOME"))
    df = spark.createDataFrame(rows, "elo_diff double, y string")
    bins = [tuple(b) for b in models.draw_bins(df).collect()]
    fit = models.fitted_draw_transform(df)
    (low_b, high_b), (low_d, high_d) = models.DRAW_BOUNDS
    assert low_b <= fit["draw_base"] <= high_b and low_d <= fit["draw_decay"] <= high_d
    assert fit["log_loss"] == pytest.approx(loss(bins, fit["draw_base"], fit["draw_decay"]), abs=1e-12)
    best = min(loss(bins, low_b + i * (high_b - low_b) / 40, low_d + j * (high_d - low_d) / 60) for i in range(41) for j in range(61))
    assert fit["log_loss"] <= best + 1e-9


def test_gradients_are_slopes(spark):
    df = spark.createDataFrame([(40.0 * i, "DRAW" if i % 3 == 0 else "AWAY") for i in range(-20, 20)], "elo_diff double, y string")
    bins = [tuple(b) for b in models.draw_bins(df).collect()]
    for r in models.draw_derivatives(models.draw_bins(df), [(0.3, 0.7), (0.2, 0.3)]).collect():
        b, d = [(0.3, 0.7), (0.2, 0.3)][r["point"]]
        assert r["loss"] == pytest.approx(loss(bins, b, d))
        assert r["g_base"] == pytest.approx((loss(bins, b + 1e-6, d) - loss(bins, b - 1e-6, d)) / 2e-6, abs=1e-6)
        assert r["g_decay"] == pytest.approx((loss(bins, b, d + 1e-6) - loss(bins, b, d - 1e-6)) / 2e-6, abs=1e-6)
    assert models.fitted_draw_transform(df.limit(0))["rounds"] == 0
