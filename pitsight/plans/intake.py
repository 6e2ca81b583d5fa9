"""Intake, identity, slots, quality and leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import times
from ..operators import asof, intake
from ..sources import bridge
from .history import FEATURES, features
from .registry import query
from .reports import rounded

EVENTS = """, pe AS (
  SELECT match_id, kickoff_at, h.team_name AS home_team, a.team_name AS away_team FROM m JOIN t h ON h.team_id = home_team_id JOIN t a ON a.team_id = away_team_id)"""


def provider_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw provider JSON, one event a match: bookmakers with markets and outcomes, some of them faulty."""
    m = bridge.matches(spark, sf_dir)
    t = bridge.teams(spark, sf_dir)
    named = m.join(t.select(F.col("team_id").alias("home_team_id"), F.col("team_name").alias("home_team")), "home_team_id").join(t.select(F.col("team_id").alias("away_team_id"), F.col("team_name").alias("away_team")), "away_team_id")
    s = bridge.odds(spark, sf_dir, m)
    k = F.col("snapshot_id") % 1000
    outcome = lambda n, p: F.struct(n.alias("name"), p.alias("price"))
    home = outcome(F.col("home_team"), F.col("home_odds"))
    draw = outcome(F.lit("Draw"), F.when(k % 17 == 0, F.lit(1e0)).otherwise(F.col("draw_odds")))
    away = outcome(F.when(k % 13 == 0, F.lit("Someone")).otherwise(F.col("away_team")), F.col("away_odds"))
    outcomes = F.when(F.col("away_odds").isNull(), F.array(home, draw)).when(k % 11 == 0, F.array(home, home, draw)).otherwise(F.array(home, draw, away))
    market = F.struct(F.when(k % 7 == 0, "totals").otherwise("h2h").alias("key"), outcomes.alias("outcomes"))
    book = F.struct(F.concat(F.lit("book"), F.col("bookmaker").cast("string"), F.lit("-"), F.col("snapshot_id").cast("string")).alias("key"), F.array(market).alias("markets"))
    joined = named.select("match_id", "kickoff_at", "home_team", "away_team").join(s.drop("kickoff_at"), "match_id")
    grouped = joined.groupBy("match_id", "kickoff_at", "home_team", "away_team").agg(F.collect_list(book).alias("bookmakers"))
    body = F.struct(F.concat(F.lit("ev"), F.col("match_id").cast("string")).alias("id"), F.lit("soccer").alias("sport_key"), X.F.date_format("kickoff_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("commence_time"), "home_team", "away_team", "bookmakers")
    return grouped.select(F.to_json(body).alias("body"))


@query("""SELECT reason, count(*) AS n, round(sum(coalesce(home_odds, 0e0)), 2) AS home_sum FROM (
  SELECT CASE WHEN k % 7 = 0 THEN 'unsupported_market' WHEN away_odds IS NOT NULL AND k % 11 <> 0 AND k % 13 = 0 THEN 'unknown_outcome' WHEN away_odds IS NOT NULL AND k % 11 = 0 THEN 'duplicate_outcome'
    WHEN k % 17 = 0 THEN 'invalid_price' WHEN away_odds IS NULL THEN 'incomplete_market' ELSE 'taken' END AS reason, home_odds FROM (SELECT *, snapshot_id % 1000 AS k FROM s)) GROUP BY reason""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider JSON parsed with a fixed schema and flattened over three levels, faulty markets named."""
    events = provider_events(spark, sf_dir).select(F.from_json("body", intake.EVENT_SCHEMA).alias("e")).select("e.*")
    flat = intake.flatten_odds(events)
    return flat.groupBy(F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("home_odds", F.lit(0e0))), 2).alias("home_sum"))


STATES = "MAP {" + ", ".join(f"{k}: '{v}'" for k, v in intake.STATE_CODES.items()) + "}"


@query(f"SELECT coalesce({STATES}[CAST(match_id % 28 AS INT)], 'unknown_status') AS status, count(*) AS n FROM m GROUP BY 1")
def status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("match_id") % 28).cast("int")
    m = bridge.matches(spark, sf_dir)
    return m.groupBy(F.coalesce(intake.status_of(code, intake.STATE_CODES), F.lit("unknown_status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"
#: Names with letters beyond Latin-1, with ones that no accent explains, and decomposed ones.
NAMES = ["Beşiktaş", "Dinamo București", "Bodø/Glimt", "Großaspach", "Łódź", "Žalgiris", "Þór", "Đakovo", "São Paulo F.C.", "Cafe\u0301 Ñandú", "Αθήνα", "!!"]
NAME_SQL = ", ".join(f"(-{i + 1}, '{n}', 'xx')" for i, n in enumerate(NAMES))


@query("SELECT doc_id, " + SLUG.format(x="split_part(text, '.', 1)") + " AS slug, left('team_' || " + SLUG.format(x="split_part(text, ' ', 1)") + " || '-' || " + SLUG.format(x="lang") + f", 128) AS team_key FROM (SELECT doc_id, text, lang FROM documents UNION ALL SELECT * FROM (VALUES {NAME_SQL}) v(doc_id, text, lang))")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bridge.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    d = d.union(spark.createDataFrame([(-i - 1, n, "xx") for i, n in enumerate(NAMES)], d.schema))
    first = F.substring_index("text", ".", 1)
    return d.select("doc_id", X.slugify(first).alias("slug"), X.canonical_id("team", F.substring_index("text", " ", 1), F.col("lang")).alias("team_key"))


KEYS = EVENTS + ", ky AS (SELECT match_id, 'football|' || " + SLUG.format(x="home_team") + " || '|' || " + SLUG.format(x="away_team") + " || '|' || strftime(kickoff_at, '%Y-%m-%dT%H:%M:%SZ') AS key, 'football|' || " + SLUG.format(x="away_team") + " || '|' || " + SLUG.format(x="home_team") + " || '|' || strftime(kickoff_at, '%Y-%m-%dT%H:%M:%SZ') AS rev FROM pe)"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, t = bridge.matches(spark, sf_dir), bridge.teams(spark, sf_dir)
    named = m.join(t.select(F.col("team_id").alias("home_team_id"), F.col("team_name").alias("home_team")), "home_team_id").join(t.select(F.col("team_id").alias("away_team_id"), F.col("team_name").alias("away_team")), "away_team_id")
    return named.select("match_id", X.natural_key(F.col("home_team"), F.col("away_team"), F.col("kickoff_at")).alias("key"))


@query(KEYS + " SELECT match_id, key, rev AS reversed_key FROM ky")
def natural_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).select("match_id", "key", X.reversed_key(F.col("key")).alias("reversed_key"))


@query(KEYS + """, cat AS (SELECT key, min(match_id) AS match_id FROM ky GROUP BY key),
e AS (SELECT match_id AS event_id, CASE match_id % 5 WHEN 0 THEN key WHEN 1 THEN replace(key, 'nation', 'land') WHEN 2 THEN rev WHEN 3 THEN key || 'x' ELSE key END AS key FROM ky),
e2 AS (SELECT event_id, key, replace(key, 'land', 'nation') AS alias_key, split_part(key, '|', 1) || '|' || split_part(key, '|', 3) || '|' || split_part(key, '|', 2) || '|' || split_part(key, '|', 4) AS reversed_key FROM e)
SELECT status, count(*) AS n, CAST(sum(mid) AS BIGINT) AS match_sum FROM (SELECT event_id, CASE WHEN a.match_id IS NOT NULL THEN 'exact' WHEN b.match_id IS NOT NULL THEN 'alias' WHEN c.match_id IS NOT NULL THEN 'inverted' ELSE 'unmatched' END AS status,
  coalesce(a.match_id, b.match_id, c.match_id) AS mid FROM e2 LEFT JOIN cat a ON a.key = e2.key LEFT JOIN cat b ON b.key = e2.alias_key LEFT JOIN cat c ON c.key = e2.reversed_key) GROUP BY status""")
def natural_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds events matched by exact key, alias and exchanged sides."""
    catalog = keyed(spark, sf_dir)
    k = F.col("match_id") % 5
    key = F.when(k == 1, F.replace("key", F.lit("nation"), F.lit("land"))).when(k == 2, X.reversed_key(F.col("key"))).when(k == 3, F.concat("key", F.lit("x"))).otherwise(F.col("key"))
    events = catalog.select(F.col("match_id").alias("event_id"), key.alias("key")).withColumns({"alias_key": F.replace("key", F.lit("land"), F.lit("nation")), "reversed_key": X.reversed_key(F.col("key"))})
    return intake.match_events(events, catalog).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("match_id").alias("match_sum"))


@query("""SELECT e1.event_id AS left_id, e2.event_id AS right_id FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'purchase') e1
JOIN (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'error') e2 ON abs(e1.t - e2.t) <= 120""")
def band_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of events at most 120 seconds apart, by time buckets."""
    e = bridge.read(spark, sf_dir, "events")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    left = e.where("event_type = 'purchase'").select(F.col("event_id").alias("left_id"), at.alias("t1"))
    right = e.where("event_type = 'error'").select(F.col("event_id").alias("right_id"), at.alias("t2"))
    return asof.band_join(left, right, "t1", "t2", 120).select("left_id", "right_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.read(spark, sf_dir, "events")
    return intake.first_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.read(spark, sf_dir, "events")
    return intake.last_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows (even ids) updated by arriving ones (odd ids)."""
    e = bridge.read(spark, sf_dir, "events")
    return intake.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"], True).select("user_id", "event_id", "value")


@query("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'missing_k' WHEN value <= 0 THEN 'bad_value' WHEN length(props) > 40 THEN 'too_large' END AS reason FROM events")
def payload_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw payloads parsed and checked; the first failing rule is named."""
    k = F.from_json("props", "k int")["k"]
    reason = F.when(k.isNull(), "missing_k").when(F.col("value") <= 0, "bad_value").when(F.length("props") > 40, "too_large")
    return bridge.read(spark, sf_dir, "events").select("event_id", "user_id", k.alias("k"), reason.alias("reason"))


@query("SELECT s.match_id % 10 AS k, count(*) AS n FROM s WHERE EXISTS (SELECT 1 FROM m WHERE m.match_id = s.match_id AND status = 'finished') GROUP BY 1")
def guarded_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    s = bridge.odds(spark, sf_dir, m)
    return intake.guarded(s, m.where("status = 'finished'"), "match_id").groupBy((F.col("match_id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT match_id, available_at, count(DISTINCT (home_odds, draw_odds, away_odds)) AS n_payloads FROM s GROUP BY match_id, available_at HAVING count(DISTINCT (home_odds, draw_odds, away_odds)) > 1""")
def ambiguous_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.ambiguous_snapshots(bridge.odds(spark, sf_dir), ["match_id", "available_at"], ["home_odds", "draw_odds", "away_odds"])


@query("SELECT match_id, max(available_at) FILTER (WHERE available_at <= kickoff_at) AS last_before, min(available_at) FILTER (WHERE available_at > kickoff_at) AS first_after FROM s GROUP BY match_id HAVING last_before IS NOT NULL AND first_after IS NOT NULL")
def two_sided_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.first_with_both_sides(bridge.odds(spark, sf_dir))


@query("SELECT league, CAST(kickoff_at AS DATE) AS day, min(kickoff_at) AS slot_at, count(*) AS n_matches FROM m GROUP BY 1, 2")
def slot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    return m.groupBy("league", F.to_date("kickoff_at").alias("day")).agg(F.min("kickoff_at").alias("slot_at"), F.count(F.lit(1)).alias("n_matches"))


THIN = """, sl AS (SELECT DISTINCT league, CAST(epoch(kickoff_at) AS BIGINT) AS slot_s FROM m),
th AS (SELECT league, min(slot_s) AS slot_s FROM sl GROUP BY league UNION ALL SELECT th.league, (SELECT min(sl.slot_s) FROM sl WHERE sl.league = th.league AND sl.slot_s >= th.slot_s + 216000) FROM th WHERE th.slot_s IS NOT NULL)"""


@query(THIN + " SELECT league, slot_s FROM th WHERE slot_s IS NOT NULL")
def slot_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kickoff times of each league at least 60 hours after the last one kept."""
    slots = bridge.matches(spark, sf_dir).select("league", F.unix_seconds(F.col("kickoff_at").cast("timestamp")).alias("slot_s"))
    return intake.thinned(slots, "league", "slot_s", 216_000)


TIERS = "CASE " + " ".join(f"WHEN res = '{k}' THEN CASE WHEN age <= {a} THEN 'fresh' WHEN age <= {b} THEN 'acceptable' ELSE 'stale' END" for k, (a, b) in times.FRESHNESS.items()) + " END"


@query(f"""SELECT res AS resource, {TIERS} AS tier, count(*) AS n FROM (SELECT CASE event_id % 10 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(times.FRESHNESS))} END AS res,
  (epoch_us(TIMESTAMP '2024-01-04 00:00:00') - epoch_us(ts)) / 1e6 AS age FROM events) GROUP BY 1, 2""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, times.FRESHNESS))
    resource = F.element_at(names, (F.col("event_id") % 10 + 1).cast("int"))
    age = times.seconds_between(F.col("ts"), F.lit("2024-01-04 00:00:00").cast("timestamp_ntz"))
    e = bridge.read(spark, sf_dir, "events")
    return e.groupBy(resource.alias("resource"), times.freshness(resource, age).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


AUDITED = ["elo_diff", "home_form_5", "away_form_5", "home_goals_for_10", "away_goals_against_10", "h2h_matches", "home_matches_played"]


@query(FEATURES + ", au AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM feats WHERE status = 'finished'" for c in AUDITED) + """)
SELECT feature, count(*) AS n, round(avg(CAST(x IS NULL AS INT)), 6) AS null_rate, count(DISTINCT round(x, 6)) AS n_distinct, round(min(x), 4) AS low, round(max(x), 4) AS high, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(quantile_cont(x, 0.5), 4) AS p50 FROM au GROUP BY feature""")
def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(bridge.matches(spark, sf_dir)).where("status = 'finished'")
    out = intake.audit(rows.withColumn("elo_diff", F.round("elo_diff", 6)), AUDITED)
    return rounded(rounded(out, "null_rate"), "low", "high", "mean", "std", "p50", digits=4)


@query(FEATURES + """ SELECT count(*) AS n, count(*) - count(DISTINCT match_id) AS duplicates, count(*) FILTER (WHERE abs(elo_diff - (home_elo_pre - away_elo_pre)) > 1e-9) AS elo_diff_errors,
  count(*) FILTER (WHERE home_form_5_available <> CAST(home_matches_played >= 5 AS INT)) AS flag_errors, count(*) FILTER (WHERE h2h_home_wins + h2h_draws + h2h_away_wins <> h2h_matches) AS h2h_errors,
  count(*) FILTER (WHERE home_form_5 > 15 OR home_form_10 > 30 OR home_form_10 < home_form_5) AS form_errors FROM feats WHERE status = 'finished'""")
def consistency_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(bridge.matches(spark, sf_dir)).where("status = 'finished'")
    c = F.col
    return rows.agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct("match_id")).alias("duplicates"), F.count_if(F.abs(c("elo_diff") - (c("home_elo_pre") - c("away_elo_pre"))) > 1e-9).alias("elo_diff_errors"),
        F.count_if(c("home_form_5_available") != (c("home_matches_played") >= 5).cast("int")).alias("flag_errors"), F.count_if(c("h2h_home_wins") + c("h2h_draws") + c("h2h_away_wins") != c("h2h_matches")).alias("h2h_errors"),
        F.count_if((c("home_form_5") > 15) | (c("home_form_10") > 30) | (c("home_form_10") < c("home_form_5"))).alias("form_errors"),
    )


@query("""SELECT 'odds_after_cutoff' AS check_name, count(*) FILTER (WHERE available_at > kickoff_at) AS violations FROM lo UNION ALL SELECT 'result_before_kickoff', count(*) FILTER (WHERE available_at <= kickoff_at) FROM m
UNION ALL SELECT 'finished_without_score', count(*) FILTER (WHERE status = 'finished' AND home_score IS NULL) FROM m UNION ALL SELECT 'scheduled_with_score', count(*) FILTER (WHERE status = 'scheduled' AND home_score IS NOT NULL) FROM m
UNION ALL SELECT 'team_plays_itself', count(*) FILTER (WHERE home_team_id = away_team_id) FROM m""")
def leak_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of each point-in-time rule; all checks on matches are one pass."""
    m = bridge.matches(spark, sf_dir)
    late = asof.latest_odds(bridge.odds(spark, sf_dir, m)).agg(F.count_if(F.col("available_at") > F.col("kickoff_at")).alias("odds_after_cutoff"))
    own = m.agg(
        F.count_if(F.col("available_at") <= F.col("kickoff_at")).alias("result_before_kickoff"), F.count_if((F.col("status") == "finished") & F.col("home_score").isNull()).alias("finished_without_score"),
        F.count_if((F.col("status") == "scheduled") & F.col("home_score").isNotNull()).alias("scheduled_with_score"), F.count_if(F.col("home_team_id") == F.col("away_team_id")).alias("team_plays_itself"),
    )
    return late.unpivot([], late.columns, "check_name", "violations").unionByName(own.unpivot([], own.columns, "check_name", "violations"))


PROBE = """SELECT {hours} AS hours, count(*) AS n_changed FROM lo FULL JOIN (
  SELECT match_id, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY available_at DESC, snapshot_id DESC) AS r FROM (
    SELECT snapshot_id, match_id, kickoff_at, available_at, away_odds FROM s UNION ALL SELECT snapshot_id + 5, match_id, kickoff_at, kickoff_at + to_hours({hours}), 30e0 FROM s WHERE snapshot_id % 3 = 0)
    WHERE available_at <= kickoff_at AND away_odds IS NOT NULL) WHERE r = 1) x ON x.match_id = lo.match_id WHERE x.snapshot_id IS DISTINCT FROM lo.snapshot_id"""


@query(" UNION ALL ".join(PROBE.format(hours=h) for h in (24, 1, 0, -1)))
def future_odds_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic odds for a third of all snapshots, so many hours after kickoff: matches whose as-of odds change. Those
    after kickoff must change none; those at or before it show that the probe would be seen."""
    s = bridge.odds(spark, sf_dir)
    out = None
    for hours in (24, 1, 0, -1):
        one = asof.probe_changes(s, F.col("snapshot_id") % 3 == 0, hours).select(F.lit(hours).alias("hours"), "n_changed")
        out = one if out is None else out.union(one)
    return out


@query("SELECT coalesce(a.match_id, b.match_id) AS match_id, CASE WHEN b.match_id IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT match_id FROM m WHERE match_id % 7 <> 0) a FULL JOIN (SELECT match_id FROM m WHERE match_id % 5 <> 0) b ON a.match_id = b.match_id WHERE a.match_id IS NULL OR b.match_id IS NULL")
def universe_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir).select("match_id")
    a, b = m.where("match_id % 7 <> 0").withColumn("in_a", F.lit(True)), m.where("match_id % 5 <> 0").withColumn("in_b", F.lit(True))
    joined = a.join(b, "match_id", "full_outer").where(F.col("in_a").isNull() | F.col("in_b").isNull())
    return joined.select("match_id", F.when(F.col("in_b").isNull(), "missing").otherwise("extra").alias("side"))


@query("SELECT (SELECT count(*) FROM m) AS matches, (SELECT count(*) FROM s) AS snapshots, (SELECT count(*) FROM t) AS teams, (SELECT count(*) FROM events) AS events")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [count(m, "matches"), count(bridge.odds(spark, sf_dir, m), "snapshots"), count(bridge.teams(spark, sf_dir), "teams"), count(bridge.read(spark, sf_dir, "events"), "events")]
    out = parts[0]
    for part in parts[1:]:
        # One row each.
        out = out.crossJoin(F.broadcast(part))
    return out


@query("SELECT season, league, count(*) AS n, count(*) FILTER (WHERE status = 'finished') AS finished, round(avg(home_score + away_score), 6) AS mean_goals FROM m GROUP BY ROLLUP (season, league)")
def season_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    return m.rollup("season", "league").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "finished").alias("finished"), F.round(F.avg(F.col("home_score") + F.col("away_score")), 6).alias("mean_goals"))


@query("SELECT league, team_id FROM (SELECT league, home_team_id AS team_id FROM m UNION SELECT league, away_team_id FROM m)")
def teams_by_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    return m.select("league", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).distinct()


@query("SELECT bookmaker, count(*) AS n, CASE WHEN count(*) FILTER (WHERE away_odds IS NULL) > 0 THEN NULL ELSE round(sum(away_odds), 2) END AS strict_sum, count(DISTINCT match_id) AS matches FROM s GROUP BY bookmaker")
def bookmaker_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bridge.odds(spark, sf_dir)
    strict = F.when(F.count_if(F.col("away_odds").isNull()) > 0, None).otherwise(F.round(F.sum("away_odds"), 2))
    return s.groupBy("bookmaker").agg(F.count(F.lit(1)).alias("n"), strict.alias("strict_sum"), F.countDistinct("match_id").alias("matches"))


@query("SELECT snapshot_id, match_id, bookmaker, home_odds, lag(home_odds) OVER (PARTITION BY match_id, bookmaker ORDER BY available_at, snapshot_id) AS previous_home_odds FROM s")
def odds_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.previous_changes(bridge.odds(spark, sf_dir)).select("snapshot_id", "match_id", "bookmaker", "home_odds", "previous_home_odds")


TEAM_ROWS = """, raw AS (SELECT c_custkey AS provider_id, c_name AS name, """ + SLUG.format(x="'nation ' || (c_custkey % 30)") + """ AS slug FROM customer),
kn AS (SELECT team_id, CASE WHEN team_id % 2 = 0 THEN team_id * 3 END AS provider_id, """ + SLUG.format(x="team_name") + """ AS slug FROM t UNION ALL SELECT team_id + 100, NULL, 'nation-7' FROM t WHERE team_id = 7),
al AS (SELECT team_id * 11 AS alias_id, team_id FROM t)"""


@query(TEAM_ROWS + """, nm AS (SELECT slug, min(team_id) AS tid, count(DISTINCT team_id) AS n FROM kn GROUP BY slug)
SELECT method, count(*) AS n, CAST(sum(tid) AS BIGINT) AS id_sum, round(avg(confidence), 6) AS confidence FROM (
  SELECT CASE WHEN k.team_id IS NOT NULL THEN 'provider_id' WHEN al.team_id IS NOT NULL THEN 'alias' WHEN nm.n = 1 THEN 'name' WHEN nm.n > 1 THEN 'ambiguous' ELSE 'new' END AS method,
    CASE WHEN k.team_id IS NOT NULL THEN k.team_id WHEN al.team_id IS NOT NULL THEN al.team_id WHEN nm.n = 1 THEN nm.tid END AS tid, CASE WHEN k.team_id IS NOT NULL OR al.team_id IS NOT NULL THEN 1e0 WHEN nm.n = 1 THEN 0.95e0 END AS confidence
  FROM raw LEFT JOIN (SELECT * FROM kn WHERE provider_id IS NOT NULL) k ON k.provider_id = raw.provider_id LEFT JOIN al ON al.alias_id = raw.provider_id LEFT JOIN nm ON nm.slug = raw.slug) GROUP BY method""")
def team_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider teams resolved by id, alias and unique name."""
    t = bridge.teams(spark, sf_dir)
    rows = bridge.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("provider_id"), F.col("c_name").alias("name"), X.slugify(F.concat(F.lit("nation "), (F.col("c_custkey") % 30).cast("string"))).alias("slug"))
    known = t.select("team_id", F.when(F.col("team_id") % 2 == 0, F.col("team_id") * 3).alias("provider_id"), X.slugify(F.col("team_name")).alias("slug"))
    known = known.union(t.where("team_id = 7").select(F.col("team_id") + 100, F.lit(None).cast("long"), F.lit("nation-7")))
    resolved = intake.resolve_teams(rows, known, t.select((F.col("team_id") * 11).alias("alias_id"), "team_id"))
    return resolved.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum("team_id").alias("id_sum"), F.round(F.avg("confidence"), 6).alias("confidence"))
