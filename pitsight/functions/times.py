"""Time functions: freshness tiers, availability, ages, day chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds for which a resource is fresh, then acceptable.
FRESHNESS = {
    "odds": (900, 7_200),
    "leagues": (21_600, 86_400),
    "seasons": (21_600, 86_400),
    "fixtures": (300, 1_800),
    "standings": (21_600, 86_400),
    "injuries": (21_600, 86_400),
    "lineups": (3_600, 10_800),
    "match_events": (300, 1_800),
    "team_stats": (21_600, 86_400),
    "player_stats": (21_600, 86_400),
}


def seconds_between(earlier: Column, later: Column) -> Column:
    """Seconds from one time to another, with fractions."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / 1e6


def freshness(resource: Column, age_seconds: Column, terminal: Column | None = None) -> Column:
    """fresh, acceptable or stale by the resource's tiers; facts about finished matches are always fresh."""
    out = F.when(terminal, "fresh") if terminal is not None else None
    for name, (fresh, acceptable) in FRESHNESS.items():
        here = F.when(age_seconds <= fresh, "fresh").when(age_seconds <= acceptable, "acceptable").otherwise("stale")
        out = F.when(resource == name, here) if out is None else out.when(resource == name, here)
    return out


def result_available_at(kickoff: Column, collected: Column) -> Column:
    """When a result counts as known: collection, but three hours after kickoff at most and never at kickoff itself."""
    at = F.least(collected, kickoff + F.expr("INTERVAL 3 HOURS"))
    return F.when(at <= kickoff, kickoff + F.expr("INTERVAL 90 MINUTES")).otherwise(at)


def day_chunks(start: Column, end: Column, days: int) -> Column:
    """Array of (chunk_start, chunk_end) that cover start to end, each of so many days less a second."""
    starts = F.sequence(start, end, F.make_dt_interval(F.lit(days)))
    return F.transform(starts, lambda s: F.struct(s.alias("chunk_start"), F.least(s + F.make_dt_interval(F.lit(days)) - F.expr("INTERVAL 1 SECOND"), end).alias("chunk_end")))


def rfc3339(at: Column) -> Column:
    return F.date_format(F.date_trunc("second", at), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def overlaps(start: Column, end: Column, from_: Column, to: Column) -> Column:
    """Whether two ranges share a moment; a null end is open."""
    return (F.coalesce(start, from_) <= to) & (F.coalesce(end, to) >= from_)


def backoff_seconds(attempt: Column, retry_after: Column) -> Column:
    """Wait before a request is repeated: half a second, doubled with each attempt, up to eight; or what the provider
    asks for, if that is longer."""
    return F.greatest(F.coalesce(retry_after.cast("double"), F.lit(0e0)), F.least(F.lit(8e0), F.lit(0.5) * F.pow(F.lit(2e0), attempt)))
