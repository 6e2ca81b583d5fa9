"""As-of lookups and point-in-time visibility.

All of them are one equi-join on the match and one grouped maximum or window per match: rows of one match are few,
so partitions stay even, and partial aggregation runs before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_market() -> Column:
    return (F.col("home_odds") > 1) & (F.col("draw_odds") > 1) & (F.col("away_odds") > 1)


def latest_odds(snapshots: DataFrame, cutoff: str = "kickoff_at", inclusive: bool = True, complete_only: bool = True) -> DataFrame:
    """The last snapshot of each match that was available at its cutoff: the row with the largest
    (available_at, snapshot_id). Inclusive by default; matches without such a snapshot give no row."""
    before = F.col("available_at") <= F.col(cutoff) if inclusive else F.col("available_at") < F.col(cutoff)
    kept = snapshots.where(before & complete_market()) if complete_only else snapshots.where(before)
    whole = F.struct(*(c for c in snapshots.columns if c != "match_id"))
    last = kept.groupBy("match_id").agg(F.max_by(whole, F.struct("available_at", "snapshot_id")).alias("last"))
    return last.select("match_id", "last.*")


def odds_status(matches: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(match_id, status, n_snapshots, n_eligible): ok, incomplete (only incomplete markets were available in time),
    future_only (every snapshot came later) or unavailable (none at all)."""
    in_time = F.col("available_at") <= F.col("kickoff_at")
    counts = snapshots.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(in_time).alias("in_time"), F.count_if(in_time & complete_market()).alias("complete")
    )
    joined = matches.select("match_id").join(counts, "match_id", "left")
    n, eligible = F.coalesce("n", F.lit(0)), F.coalesce("in_time", F.lit(0))
    status = F.when(F.col("complete") > 0, "ok").when(eligible > 0, "incomplete").when(n > 0, "future_only").otherwise("unavailable")
    return joined.select("match_id", status.alias("status"), n.alias("n_snapshots"), eligible.alias("n_eligible"))


def visible_before(facts: DataFrame, cutoffs: DataFrame, key: str) -> DataFrame:
    """Facts of a key that were available strictly before each cutoff and whose own event, if known, was too."""
    joined = facts.join(cutoffs, key)
    return joined.where((F.col("available_at") < F.col("cutoff_at")) & (F.col("event_at").isNull() | (F.col("event_at") < F.col("cutoff_at"))))


def band_join(left: DataFrame, right: DataFrame, at: str, other: str, seconds: int, on: dict[str, str] | None = None) -> DataFrame:
    """Pairs whose times (epoch seconds) lie at most so many seconds apart: an equi-join on time buckets of twice that
    width, each left row offered to its own and both neighbouring ones, and on the columns (left: right) of on."""
    width = 2 * seconds
    bucket = F.floor(F.col(at) / width)
    offered = left.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    placed = right.withColumn("_bucket", F.floor(F.col(other) / width))
    keys = F.col("bucket") == F.col("_bucket")
    for mine, theirs in (on or {}).items():
        keys = keys & (F.col(mine) == F.col(theirs))
    return offered.join(placed, keys).where(F.abs(F.col(at) - F.col(other)) <= seconds).drop("bucket", "_bucket")


def snapshot_states(matches: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per match: number of snapshots, first and last availability, and how many came by kickoff; zero rows included."""
    states = snapshots.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("available_at").alias("first_at"), F.max("available_at").alias("last_at"),
        F.count_if(F.col("available_at") <= F.col("kickoff_at")).alias("n_by_kickoff"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return matches.select("match_id").join(states, "match_id", "left").select("match_id", zero("n").alias("n"), "first_at", "last_at", zero("n_by_kickoff").alias("n_by_kickoff"))


def ambiguous_snapshots(snapshots: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Keys under which different payloads stand."""
    return snapshots.groupBy(*keys).agg(F.countDistinct(F.struct(*payload)).alias("n_payloads")).where("n_payloads > 1")


def first_with_both_sides(snapshots: DataFrame) -> DataFrame:
    """Matches with a snapshot both by and after kickoff, each with the last one before and the first one after."""
    by = F.col("available_at") <= F.col("kickoff_at")
    return (
        snapshots.groupBy("match_id").agg(F.max(F.when(by, F.col("available_at"))).alias("last_before"), F.min(F.when(~by, F.col("available_at"))).alias("first_after"))
        .where(F.col("last_before").isNotNull() & F.col("first_after").isNotNull())
    )


def previous_changes(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with the home odds of the one before it for the same match and bookmaker."""
    w = Window.partitionBy("match_id", "bookmaker").orderBy("available_at", "snapshot_id")
    return snapshots.withColumn("previous_home_odds", F.lag("home_odds").over(w))


def probe_changes(snapshots: DataFrame, of: Column, hours: int) -> DataFrame:
    """(n_changed): matches whose as-of odds change if the snapshots that `of` names are offered again with conspicuous
    odds, so many hours after kickoff."""
    later = snapshots.where(of).withColumns({
        "snapshot_id": F.col("snapshot_id") + 5, "available_at": F.col("kickoff_at") + F.make_dt_interval(hours=F.lit(hours)), "home_odds": F.lit(1.01), "draw_odds": F.lit(20e0), "away_odds": F.lit(30e0),
    })
    before = latest_odds(snapshots).select("match_id", F.col("snapshot_id").alias("a"))
    after = latest_odds(snapshots.unionByName(later)).select("match_id", F.col("snapshot_id").alias("b"))
    return before.join(after, "match_id", "full_outer").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed"))
