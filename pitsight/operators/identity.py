"""Identity tables: bindings, aliases, rewritten ids, rebuilt keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import band_join


def binding_conflicts(bindings: DataFrame) -> DataFrame:
    """Provider keys that stand for more than one canonical id."""
    return bindings.groupBy("provider", "entity_type", "provider_entity_id").agg(F.countDistinct("canonical_id").alias("n_ids")).where("n_ids > 1")


def alias_problems(aliases: DataFrame) -> DataFrame:
    """(problem, alias, n): aliases that repeat, stand for several names, or stand for themselves."""
    by = aliases.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"), F.count_if(F.col("alias") == F.col("name")).alias("own"))
    found = F.array_compact(F.array(F.when(F.col("n") > F.col("names"), "repeated"), F.when(F.col("names") > 1, "ambiguous"), F.when(F.col("own") > 0, "identity")))
    return by.select(F.explode(found).alias("problem"), "alias", "n")


def rewritten(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """rows with each id column replaced by what the mapping (old_id, new_id) says; ids that it doesn't name stay."""
    out = rows
    for c in columns:
        here = mapping.select(F.col("old_id").alias(f"_old_{c}"), F.col("new_id").alias(f"_new_{c}"))
        out = out.join(here, out[c] == F.col(f"_old_{c}"), "left").withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_old_{c}", f"_new_{c}")
    return out


def key_bindings(keys: DataFrame) -> DataFrame:
    """(key, match_id): the first binding of each key. keys: (key, match_id, place), a lower place comes first."""
    w = Window.partitionBy("key").orderBy("place", "match_id")
    return keys.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("key", "match_id")


def identity_statistics(resolutions: DataFrame) -> DataFrame:
    """One row: distinct events, those matched, those never matched, and events by exact key and by alias. An event with
    several resolutions counts once, as exact if any is."""
    by = resolutions.groupBy("event_id").agg(F.bool_or(F.col("status") == "exact").alias("exact"), F.bool_or(F.col("status") == "alias").alias("alias"))
    some = F.col("exact") | F.col("alias")
    return by.agg(F.count(F.lit(1)).alias("events"), F.count_if(some).alias("matched"), F.count_if(~some).alias("rejected"), F.count_if("exact").alias("by_exact"), F.count_if(~F.col("exact") & F.col("alias")).alias("by_alias"))


def franchise_keys(rows: DataFrame, aliases: DataFrame, columns: list[str], league: str = "mls") -> DataFrame:
    """rows with <column>_key and <column>_aliased for each slug column: in the named league the key that aliases (slug,
    key) give the slug, else the slug itself; aliased says whether the key is another name. A slug has one key."""
    out = rows
    for c in columns:
        here = aliases.select(F.col("slug").alias(f"_slug_{c}"), F.col("key").alias(f"_key_{c}"))
        key = F.coalesce(F.when(F.col("league") == league, F.col(f"_key_{c}")), F.col(c))
        joined = out.join(here, F.col(c) == F.col(f"_slug_{c}"), "left")
        out = joined.withColumns({f"{c}_key": key, f"{c}_aliased": key != F.col(c)}).drop(f"_slug_{c}", f"_key_{c}")
    return out


def same_franchise_events(matches: DataFrame, events: DataFrame, seconds: int = 120) -> DataFrame:
    """(match_id, event_id): pairs of the same franchises on the same sides that begin at most so many seconds apart.

    matches: (match_id, home_key, away_key, t), events: (event_id, home_key, away_key, t), t in seconds. The keys are
    part of the equi-join, beside the time buckets."""
    left = matches.select("match_id", F.col("home_key").alias("h1"), F.col("away_key").alias("a1"), F.col("t").alias("t1"))
    right = events.select("event_id", F.col("home_key").alias("h2"), F.col("away_key").alias("a2"), F.col("t").alias("t2"))
    return band_join(left, right, "t1", "t2", seconds, {"h1": "h2", "a1": "a2"}).select("match_id", "event_id").distinct()


def alias_keys(matches: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, match_id): every key that a match can be found under, bound to the first that has it: the original key
    first, then all combinations of the two sides' own slugs and aliases.

    matches: (match_id, home_team_id, away_team_id, home_slug, away_slug, at), at as text; aliases: (team_id, slug)."""
    listed = aliases.groupBy("team_id").agg(F.sort_array(F.collect_set("slug")).alias("slugs"))
    out = matches
    for side in ("home", "away"):
        here = listed.select(F.col("team_id").alias(f"{side}_team_id"), F.col("slugs").alias(f"_{side}"))
        out = out.join(here, f"{side}_team_id", "left")
    every = lambda side: F.array_distinct(F.concat(F.array(f"{side}_slug"), F.coalesce(f"_{side}", F.array().cast("array<string>"))))
    each = out.select("match_id", "home_slug", "away_slug", "at", F.explode(every("home")).alias("h"), every("away").alias("aways")).select("*", F.explode("aways").alias("a"))
    place = (~((F.col("h") == F.col("home_slug")) & (F.col("a") == F.col("away_slug")))).cast("int")
    return key_bindings(each.select(F.concat_ws("|", F.lit("football"), "h", "a", "at").alias("key"), "match_id", place.alias("place")))
