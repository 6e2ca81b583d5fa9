"""Value of selections against the market, eligibility of picks, ranking and settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import odds as O

SELECTIONS = ("HOME", "DRAW", "AWAY")
MAX_AGE_H = 24


def value_rows(quotes: DataFrame, predictions: DataFrame) -> DataFrame:
    """Three rows a match: selection, odds, implied and no-vig probability, overround, model probability, edge, EV."""
    home, draw, away = F.col("home_odds"), F.col("draw_odds"), F.col("away_odds")
    fair = O.no_vig(home, draw, away)
    joined = quotes.join(predictions, "match_id").withColumn("overround", O.overround(home, draw, away))
    triples = zip(SELECTIONS, (home, draw, away), fair, ("p_home", "p_draw", "p_away"))
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("selection"), o.alias("odds"), n.alias("no_vig"), F.col(p).alias("p")) for s, o, n, p in triples)))
    flat = joined.select("*", rows.alias("v")).select(*joined.columns, "v.*")
    return flat.withColumns({"implied": O.implied(F.col("odds")), "edge": O.edge(F.col("p"), F.col("odds")), "ev": O.expected_value(F.col("p"), F.col("odds"))})


def exclusion(age_h: Column, p: Column, ev: Column, edge: Column, max_age_h: float = MAX_AGE_H, min_p: float = 0e0, min_ev: float = 0e0, min_edge: float = 0e0) -> Column:
    """The first gate that a selection fails, null if it passes all."""
    return (
        F.when(age_h > max_age_h, "stale_odds").when(p < min_p, "below_minimum_model_probability").when(ev < 0, "negative_ev")
        .when(ev < min_ev, "below_minimum_ev").when(edge < 0, "negative_edge").when(edge < min_edge, "below_minimum_edge")
    )


def gated(values: DataFrame, **limits: float) -> DataFrame:
    """Value rows with their exclusion reason (null: eligible), score and freshness."""
    reason = exclusion(F.col("age_h"), F.col("p"), F.col("ev"), F.col("edge"), **limits)
    score = F.when(reason.isNull(), F.col("ev") + F.col("edge"))
    return values.withColumns({"reason": reason, "score": score, "freshness": F.when(F.col("age_h") * 2 <= limits.get("max_age_h", MAX_AGE_H), 2).otherwise(1)})


RANKING = (F.desc, "score"), (F.desc, "ev"), (F.desc, "edge"), (F.desc, "freshness"), (F.asc, "match_id"), (F.asc, "selection")


def ranking() -> list[Column]:
    return [f(c) for f, c in RANKING]


def ranked(eligible: DataFrame, within: list[str], name: str = "pick_rank") -> DataFrame:
    """Rank by score, EV, edge, freshness, match and selection within groups."""
    return eligible.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*ranking())).cast("long"))


def top_picks(eligible: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the global ranking, with ranks. Each partition gives its first offset + limit rows (a top-k, not a
    sort of everything); only those are numbered."""
    first = eligible.orderBy(*ranking()).limit(offset + limit)
    return first.withColumn("pick_rank", F.row_number().over(Window.orderBy(*ranking())).cast("long")).where(F.col("pick_rank") > offset)


def settled(picks: DataFrame, matches: DataFrame, stake: float = 1e0) -> DataFrame:
    """Picks of finished matches with outcome, hit and profit."""
    done = matches.where("status = 'finished'").select("match_id", "league", O.outcome(F.col("home_score"), F.col("away_score")).alias("outcome"))
    joined = picks.join(done, "match_id")
    return joined.withColumns({"hit": (F.col("selection") == F.col("outcome")).cast("int"), "profit": O.settle(F.col("selection"), F.col("outcome"), F.col("odds"), stake)})


def parity_errors(values: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Number of value rows whose stored figures differ from recomputed ones."""
    off = lambda stored, again: F.count_if(F.abs(F.col(stored) - again) > tolerance).alias(f"{stored}_errors")
    return values.agg(F.count(F.lit(1)).alias("n"), off("implied", F.lit(1e0) / F.col("odds")), off("edge", F.col("p") - F.lit(1e0) / F.col("odds")), off("ev", F.col("p") * F.col("odds") - 1))


def page_info(total: Column, limit: Column, offset: Column) -> Column:
    """(page, page_count, has_previous, has_next, range_start, range_end) of a page of a list."""
    size = F.greatest(limit, F.lit(1))
    return F.struct(
        (F.floor(offset / size) + 1).alias("page"), F.greatest(F.ceil(total / size), F.lit(1)).alias("page_count"), (offset > 0).alias("has_previous"), (offset + size < total).alias("has_next"),
        F.when(total == 0, 0).otherwise(offset + 1).cast("long").alias("range_start"), F.least(offset + size, total).cast("long").alias("range_end"),
    )


def page_summary(page: DataFrame) -> DataFrame:
    """(displayed, best_match, best_selection, average_ev, average_edge) of one page of picks; the best is that of the
    lowest rank. Averages are null for an empty page."""
    best = F.min_by(F.struct("match_id", "selection"), "pick_rank")
    return page.agg(F.count(F.lit(1)).alias("displayed"), best["match_id"].alias("best_match"), best["selection"].alias("best_selection"), F.avg("ev").alias("average_ev"), F.avg("edge").alias("average_edge"))


SORTS = {"edge": "edge", "ev": "ev", "probability": "p", "odds": "odds"}


def sorted_values(rows: DataFrame, sort: str) -> DataFrame:
    """Value rows by one of SORTS, highest first, ties by match and selection; any other sort leaves them as they are."""
    return rows.orderBy(F.desc(SORTS[sort]), "match_id", "selection") if sort in SORTS else rows
