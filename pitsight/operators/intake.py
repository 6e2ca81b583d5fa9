"""Intake of provider rows: flattening, status codes, identity, deduplication, upserts, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "id string, sport_key string, commence_time string, home_team string, away_team string, "
    "bookmakers array<struct<key: string, title: string, last_update: string, markets: array<struct<key: string, outcomes: array<struct<name: string, price: double>>>>>>"
)
#: A provider's integer match states and another's short codes.
STATE_CODES = {
    1: "scheduled", 2: "live", 3: "live", 4: "live", 5: "finished", 6: "live", 7: "finished", 8: "finished", 9: "live", 10: "postponed", 11: "live", 12: "cancelled",
    13: "scheduled", 14: "finished", 15: "postponed", 16: "scheduled", 17: "finished", 18: "live", 19: "scheduled", 20: "cancelled", 21: "live", 22: "live", 25: "live", 26: "scheduled",
}
SHORT_CODES = {
    "NS": "scheduled", "TBD": "scheduled", "1H": "live", "2H": "live", "HT": "live", "LIVE": "live", "FT": "finished", "AET": "finished", "PEN": "finished", "PST": "postponed", "CANC": "cancelled",
}
#: Score descriptions in order of preference.
SCORE_ORDER = ("CURRENT", "2ND_HALF", "FULLTIME", "FULL_TIME", "FT")


def status_of(code: Column, codes: dict) -> Column:
    """Canonical status of a provider's code; null for codes that aren't known. A literal map, no join."""
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), code)


def flatten_odds(events: DataFrame) -> DataFrame:
    """(event_id, bookmaker, market, n_outcomes, home_odds, draw_odds, away_odds, reason): one row for each bookmaker's
    market. reason says why a market isn't taken: another market, an unknown outcome, a repeated one, a price of one or
    less or none, or an incomplete market; null if it is taken. Events without bookmakers or markets give no row."""
    books = events.select(F.col("id").alias("event_id"), "home_team", "away_team", F.explode("bookmakers").alias("b"))
    markets = books.select("event_id", "home_team", "away_team", F.col("b.key").alias("bookmaker"), F.explode("b.markets").alias("m"))
    outcomes = F.col("m.outcomes")
    name = lambda x: F.when(x["name"] == F.col("home_team"), "HOME").when(x["name"] == F.col("away_team"), "AWAY").when(F.lower(x["name"]) == "draw", "DRAW")
    names = F.transform(outcomes, name)
    price = lambda s: F.try_element_at(F.transform(F.filter(outcomes, lambda x: name(x) == s), lambda x: x["price"]), F.lit(1))
    reason = (
        F.when(F.col("m.key") != "h2h", "unsupported_market")
        .when(F.exists(names, lambda x: x.isNull()), "unknown_outcome")
        .when(F.size(F.array_distinct(names)) < F.size(names), "duplicate_outcome")
        .when(F.exists(outcomes, lambda x: x["price"].isNull() | (x["price"] <= 1)), "invalid_price")
        .when(F.size(names) < 3, "incomplete_market")
    )
    return markets.select("event_id", "bookmaker", F.col("m.key").alias("market"), F.size(outcomes).alias("n_outcomes"), price("HOME").alias("home_odds"), price("DRAW").alias("draw_odds"), price("AWAY").alias("away_odds"), reason.alias("reason"))


def preferred_score(scores: Column, side: str) -> Column:
    """Goals of a side from an array of (description, participant, goals), by order of preference."""
    options = [F.try_element_at(F.transform(F.filter(scores, lambda s: (s["description"] == d) & (s["participant"] == side)), lambda s: s["goals"]), F.lit(1)) for d in SCORE_ORDER]
    return F.coalesce(*options)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(stored: DataFrame, arriving: DataFrame, keys: list[str], order: list[str], update: bool) -> DataFrame:
    """Stored and arriving rows by key: the latest arrival where rows are updated, what was there first where not.
    Arriving rows have later places in the order than stored ones."""
    pool = stored.withColumn("_new", F.lit(0)).unionByName(arriving.withColumn("_new", F.lit(1)))
    kept = last_wins(pool, keys, ["_new", *order]) if update else first_wins(pool, keys, ["_new", *order])
    return kept.drop("_new")


def guarded(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent exists."""
    return rows.join(parents.select(key), key, "left_semi")


def conflicts(rows: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Keys that stand for more than one payload, nulls being values: what an append-only store refuses."""
    return rows.groupBy(*keys).agg(F.countDistinct(F.struct(*payload)).alias("n")).where("n > 1").select(*keys, "n")


def checksum(payload: Column, volatile: tuple[str, ...] = ()) -> Column:
    """SHA-256 of a flat map of fields in key order, without the volatile ones."""
    entries = F.array_sort(F.map_entries(F.map_filter(payload, lambda k, _: ~k.isin(*volatile)) if volatile else payload))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "\n"), 256)


def without_secrets(headers: Column, names: tuple[str, ...] = ("authorization", "x-api-key", "cookie", "set-cookie")) -> Column:
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*names))


def resolve_teams(rows: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """(provider_id, name, team_id, method, confidence) by provider id, then alias, then a name that only one team has;
    a name of several teams is ambiguous, the rest are new.

    rows: (provider_id, name, slug); known: (team_id, provider_id, slug); aliases: (alias_id, team_id)."""
    by_id = known.select(F.col("provider_id").alias("k_id"), F.col("team_id").alias("t_id")).where(F.col("k_id").isNotNull())
    by_name = known.groupBy(F.col("slug").alias("k_slug")).agg(F.min("team_id").alias("t_name"), F.countDistinct("team_id").alias("n_name"))
    by_alias = aliases.select(F.col("alias_id").alias("a_id"), F.col("team_id").alias("t_alias"))
    joined = rows.join(by_id, F.col("provider_id") == F.col("k_id"), "left").join(by_alias, F.col("provider_id") == F.col("a_id"), "left").join(by_name, F.col("slug") == F.col("k_slug"), "left")
    method = F.when(F.col("t_id").isNotNull(), "provider_id").when(F.col("t_alias").isNotNull(), "alias").when(F.col("n_name") == 1, "name").when(F.col("n_name") > 1, "ambiguous").otherwise("new")
    team = F.when(method == "provider_id", F.col("t_id")).when(method == "alias", F.col("t_alias")).when(method == "name", F.col("t_name"))
    return joined.select("provider_id", "name", team.alias("team_id"), method.alias("method"), F.when(method.isin("provider_id", "alias"), 1e0).when(method == "name", 0.95e0).alias("confidence"))


def match_events(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Odds events against matches by natural key: exact, then alias, then with the sides exchanged, else unmatched.

    events: (event_id, key, alias_key, reversed_key), catalog: (match_id, key). One equi-join on all offered keys, then
    the best of an event's hits: the catalog is shuffled once, not once for each kind."""
    kinds = (("exact", "key"), ("alias", "alias_key"), ("inverted", "reversed_key"))
    offers = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(kind).alias("status"), F.col(column).alias("key")) for i, (kind, column) in enumerate(kinds))))
    offered = events.select("event_id", offers.alias("o")).select("event_id", "o.*").where(F.col("key").isNotNull())
    hits = offered.join(catalog.groupBy("key").agg(F.min("match_id").alias("match_id")), "key")
    best = hits.groupBy("event_id").agg(F.min_by(F.struct("status", "match_id"), "place").alias("b")).select("event_id", "b.*")
    return events.select("event_id").join(best, "event_id", "left").select("event_id", F.coalesce("status", F.lit("unmatched")).alias("status"), "match_id")


def thinned(slots: DataFrame, group: str, at: str, gap: int) -> DataFrame:
    """(group, at): of each group's times (whole numbers) the first, and each that lies at least gap after the last one
    kept. A fold over one group's sorted times, which are one a slot."""
    kept = F.aggregate(
        F.array_sort(F.collect_set(at)), F.array().cast("array<bigint>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) >= gap), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return slots.groupBy(group).agg(kept.alias("kept")).select(group, F.explode("kept").alias(at))


def audit(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Null rate, distinct values, range, mean, population deviation and median of each column. The unpivoted rows are
    first counted by value, so that the last step sees every distinct value once, however many rows have it."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("f")).select("f.*")
    counted = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("k"))
    x, k = F.col("x"), F.col("k")
    known = F.sum(F.when(x.isNotNull(), k))
    mean = F.sum(x * k) / known
    moments = counted.groupBy("feature").agg(
        F.sum("k").alias("n"), (F.coalesce(F.sum(F.when(x.isNull(), k)), F.lit(0)) / F.sum("k")).alias("null_rate"), F.count("x").alias("n_distinct"), F.min("x").alias("low"), F.max("x").alias("high"),
        mean.alias("mean"), F.percentile("x", F.lit(0.5), F.col("k")).alias("p50"),
    )
    spread = counted.join(F.broadcast(moments.select("feature", F.col("mean").alias("m"))), "feature").groupBy("feature").agg(F.sqrt(F.sum(k * (x - F.col("m")) * (x - F.col("m"))) / known).alias("std"))
    # A row a column on both sides.
    return moments.join(F.broadcast(spread), "feature").select("feature", "n", "null_rate", "n_distinct", "low", "high", "mean", "std", "p50")
