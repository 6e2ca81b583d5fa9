"""Fetch slots and odds coverage: what was asked for, what is there, what is still to be fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def partition(slots: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, state): a slot is requested if any of its targets was, else covered if all have odds, else identity_only
    if every target without odds is excluded by identity, else to be fetched.

    slots: one row a target, with booleans requested, covered, excluded."""
    state = (
        F.when(F.bool_or("requested"), "requested").when(F.bool_and("covered"), "covered")
        .when(F.bool_and(F.col("covered") | F.col("excluded")), "identity_only").otherwise("fetch")
    )
    return slots.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), state.alias("state"))


def gap_violations(slots: DataFrame, group: str, at: str, gap: int) -> DataFrame:
    """Slots that begin less than gap after the one before in their group."""
    before = F.lag(at).over(Window.partitionBy(group).orderBy(at))
    return slots.withColumn("previous", before).where(F.col(at) - F.col("previous") < gap)


def within_budget(slots: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Each group's slots in order until the first whose running cost is over the budget; that one ends the run, even
    if a later, cheaper one would fit."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = slots.withColumn("spent", F.sum(cost).over(w))
    return spent.withColumn("over", F.max((F.col("spent") > budget).cast("int")).over(w)).where("over = 0").drop("over")


def coverage_matrix(matches: DataFrame, snapshots: DataFrame, excluded: DataFrame) -> DataFrame:
    """(match_id, league, n_before, n_after, last_age_h, reason) for every match: snapshots by and after kickoff, the age
    of the last complete one, and the first reason for having none. excluded: (match_id)."""
    before = F.col("available_at") <= F.col("kickoff_at")
    complete = (F.col("home_odds") > 1) & (F.col("draw_odds") > 1) & (F.col("away_odds") > 1)
    counts = snapshots.groupBy("match_id").agg(F.count_if(before).alias("b"), F.count_if(~before).alias("a"), F.min(F.when(before & complete, F.col("age_h"))).alias("last_age_h"))
    marked = excluded.select("match_id").distinct().withColumn("out", F.lit(True))
    joined = matches.select("match_id", "league").join(counts, "match_id", "left").join(marked, "match_id", "left")
    b, a = F.coalesce("b", F.lit(0)), F.coalesce("a", F.lit(0))
    reason = (
        F.when(F.col("out"), "excluded_identity").when(a + b == 0, "no_snapshot").when(b == 0, "none_by_kickoff").when(F.col("last_age_h").isNull(), "incomplete_market")
        .when(F.col("last_age_h") > 24, "stale")
    )
    return joined.select("match_id", "league", b.alias("n_before"), a.alias("n_after"), "last_age_h", reason.alias("reason"))


def observed(events: DataFrame, key: str, order: list[str], at: str, start: str, end: str) -> DataFrame:
    """The last arrival of every event, with a mark for those inside of a half-open window."""
    last = F.max_by(F.struct(*events.columns), F.struct(*order)).alias("e")
    inside = (F.col(at) >= F.lit(start).cast("timestamp_ntz")) & (F.col(at) < F.lit(end).cast("timestamp_ntz"))
    return events.groupBy(F.col(key).alias("_key")).agg(last).select("e.*").withColumn("in_window", inside)


def unaligned(matches: DataFrame, events: DataFrame, covered: DataFrame, seconds: int = 120) -> DataFrame:
    """Matches that aren't covered and that no event's time lies within so many seconds of.

    matches: (match_id, t, ...), events: (t), covered: (match_id); times in seconds. Event times are rounded down to
    buckets, so a match looks into three of them."""
    open_ = matches.join(covered.select("match_id").distinct(), "match_id", "left_anti")
    times = events.select(F.col("t").alias("_t")).distinct().withColumn("_b", F.floor(F.col("_t") / seconds))
    near = open_.select("match_id", "t", F.explode(F.array(*(F.floor(F.col("t") / seconds) + i for i in (-1, 0, 1)))).alias("_b"))
    present = near.join(times, "_b").where(F.abs(F.col("_t") - F.col("t")) <= seconds).select("match_id").distinct()
    return open_.join(present, "match_id", "left_anti")


def day_slots(matches: DataFrame, existing: DataFrame) -> DataFrame:
    """(league, day, slot_at, n): one slot a league and day, at the first kickoff, but for those asked for before.
    matches: (league, kickoff_at), existing: (league, slot_at)."""
    slots = matches.groupBy("league", F.to_date("kickoff_at").alias("day")).agg(F.min("kickoff_at").alias("slot_at"), F.count(F.lit(1)).alias("n"))
    return slots.join(existing.select("league", "slot_at").distinct(), ["league", "slot_at"], "left_anti")
