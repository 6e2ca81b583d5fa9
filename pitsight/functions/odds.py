"""Market arithmetic on decimal odds, and probabilities from ratings and goal rates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HOME_ADVANTAGE, SCALE = 80e0, 400e0
DRAW_LOW, DRAW_HIGH = 0.05, 0.42
CLIP = 1e-15
MAX_GOALS = 10


def implied(odds: Column) -> Column:
    """1 / odds; null for missing odds or odds of one or less."""
    return F.when(odds > 1, F.lit(1e0) / odds)


def overround(home: Column, draw: Column, away: Column) -> Column:
    """Sum of the implied probabilities; null unless the market is complete."""
    return implied(home) + implied(draw) + implied(away)


def no_vig(home: Column, draw: Column, away: Column) -> tuple[Column, Column, Column]:
    """Implied probabilities scaled to one; the away side takes what rounding leaves, so that the sum is exact."""
    total = overround(home, draw, away)
    h, d = implied(home) / total, implied(draw) / total
    return h, d, F.lit(1e0) - h - d


def edge(probability: Column, odds: Column) -> Column:
    return probability - implied(odds)


def expected_value(probability: Column, odds: Column) -> Column:
    return F.when(odds > 1, probability * odds - F.lit(1e0))


def settle(selection: Column, outcome: Column, odds: Column, stake: float = 1e0) -> Column:
    """Profit of a bet: stake * (odds - 1) if won, -stake if lost; null for odds of one or less or an open outcome."""
    return F.when(outcome.isNull() | ~(odds > 1), None).when(selection == outcome, F.lit(stake) * (odds - 1)).otherwise(F.lit(-stake))


def expected_score(rating: Column, opponent: Column) -> Column:
    return F.lit(1e0) / (F.lit(1e0) + F.pow(F.lit(1e1), (opponent - rating) / SCALE))


def clipped(*probabilities: Column) -> list[Column]:
    """Probabilities held within [1e-15, 1] and scaled to a sum of one."""
    held = [F.least(F.greatest(p, F.lit(CLIP)), F.lit(1e0)) for p in probabilities]
    total = held[0]
    for p in held[1:]:
        total = total + p
    return [p / total for p in held]


def elo_1x2(diff: Column, home_advantage: float = HOME_ADVANTAGE, draw_base: float = 0.26, draw_decay: float = 0.8) -> list[Column]:
    """Home, draw and away probability for a rating difference that doesn't contain the home advantage."""
    expected = F.lit(1e0) / (F.lit(1e0) + F.pow(F.lit(1e1), -((diff + home_advantage) / SCALE)))
    draw = F.least(F.greatest(F.lit(draw_base) * F.exp(F.lit(-draw_decay) * F.abs(diff) / SCALE), F.lit(DRAW_LOW)), F.lit(DRAW_HIGH))
    return clipped((F.lit(1e0) - draw) * expected, draw, (F.lit(1e0) - draw) * (F.lit(1e0) - expected))


def poisson_1x2(home_rate: Column, away_rate: Column, max_goals: int = MAX_GOALS) -> list[Column]:
    """Home, draw and away probability of independent Poisson goal counts up to max_goals each.

    Home wins by k goals more than the away side's g: sums over array literals, no rows are made."""

    def pmf(rate: Column) -> list[Column]:
        return [F.exp(-rate) * F.pow(rate, F.lit(float(k))) / math.factorial(k) for k in range(max_goals + 1)]

    h, a = F.array(*pmf(home_rate)), F.array(*pmf(away_rate))
    pairs = F.zip_with(h, a, lambda x, y: F.struct(x.alias("h"), y.alias("a")))
    zero = F.struct(*(F.lit(0e0).alias(n) for n in ("home", "draw", "away", "h_below", "a_below")))
    summed = F.aggregate(
        pairs,
        zero,
        lambda acc, p: F.struct(
            (acc["home"] + p["h"] * acc["a_below"]).alias("home"),
            (acc["draw"] + p["h"] * p["a"]).alias("draw"),
            (acc["away"] + p["a"] * acc["h_below"]).alias("away"),
            (acc["h_below"] + p["h"]).alias("h_below"),
            (acc["a_below"] + p["a"]).alias("a_below"),
        ),
    )
    return clipped(summed["home"], summed["draw"], summed["away"])


def outcome(home_score: Column, away_score: Column) -> Column:
    """HOME, DRAW or AWAY; null unless both scores are known."""
    return F.when(home_score > away_score, "HOME").when(home_score < away_score, "AWAY").when(home_score == away_score, "DRAW")


def argmax_1x2(home: Column, draw: Column, away: Column) -> Column:
    """The selection with the largest probability; HOME before DRAW before AWAY on ties."""
    return F.when((home >= draw) & (home >= away), "HOME").when(draw >= away, "DRAW").otherwise("AWAY")


def probability_of(selection: Column, home: Column, draw: Column, away: Column) -> Column:
    return F.when(selection == "HOME", home).when(selection == "DRAW", draw).when(selection == "AWAY", away)
