"""Provider fixtures, triage of rows, times and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import odds as O
from ..functions import text as X
from ..functions import times
from ..operators import asof, fixtures, intake, rules
from ..sources import bridge, readers
from .registry import query
from .reports import rounded


def fixture_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as a provider sends them, some of them faulty."""
    m, k = bridge.matches(spark, sf_dir), F.col("match_id")
    side = lambda name, team: F.struct(F.col(team).alias("id"), F.concat(F.lit("Team "), F.col(team).cast("string")).alias("name"), F.struct(F.lit(name).alias("location")).alias("meta"))
    goals = lambda d, p, c: F.struct(F.lit(d).alias("description"), F.lit(p).alias("participant"), c.alias("goals"))
    people = F.when(k % 29 == 0, F.array(side("home", "home_team_id"))).otherwise(F.array(side("away", "away_team_id"), side("home", "home_team_id")))
    early = F.array(goals("1ST_HALF", "home", F.lit(0)), goals("2ND_HALF", "home", F.lit(9)))
    full = F.array(goals("CURRENT", "home", F.col("home_score")), goals("CURRENT", "away", F.col("away_score")))
    scores = F.when((F.col("status") != "finished") | (k % 31 == 0), early).otherwise(F.concat(early, full))
    state = F.when(k % 37 == 0, 99).when(F.col("status") == "finished", 5).otherwise(1)
    shown = F.when(k % 41 == 0, F.lit("soon")).when(k % 3 == 0, F.date_format("kickoff_at", "yyyy-MM-dd HH:mm:ss")).when(k % 3 == 1, F.date_format("kickoff_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.unix_seconds(F.col("kickoff_at").cast("timestamp")).cast("string"))
    body = F.struct(k.alias("id"), (k % 7).alias("league_id"), F.col("season").cast("long").alias("season_id"), state.alias("state_id"), shown.alias("starting_at"), (k % 43 == 0).alias("placeholder"), people.alias("participants"), scores.alias("scores"))
    return m.select(F.to_json(body).alias("body"))


FIXTURES = """, fx AS (SELECT match_id, kickoff_at, match_id % 7 AS league_id, season, home_team_id, away_team_id, CASE WHEN match_id % 37 = 0 THEN NULL ELSE status END AS st, home_score, away_score,
  CASE WHEN match_id % 43 = 0 THEN 'placeholder' WHEN match_id % 37 = 0 THEN 'unknown_status' WHEN match_id % 41 = 0 THEN 'bad_time' WHEN match_id % 29 = 0 THEN 'missing_participant' WHEN status = 'finished' AND match_id % 31 = 0 THEN 'missing_score' END AS reason FROM m)"""


@query(FIXTURES + " SELECT match_id, league_id, CAST(season AS BIGINT) AS season_id, kickoff_at, st AS status, home_team_id, away_team_id, home_score, away_score FROM fx WHERE reason IS NULL")
def fixture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture JSON parsed with a fixed schema: sides by location, scores by preference, times in three forms."""
    parsed = fixture_json(spark, sf_dir).select(F.from_json("body", fixtures.FIXTURE_SCHEMA).alias("f")).select("f.*")
    return fixtures.normalised(parsed).where(F.col("reason").isNull()).drop("reason")


@query(FIXTURES + " SELECT coalesce(reason, 'taken') AS reason, count(*) AS n FROM fx GROUP BY 1")
def fixture_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = fixture_json(spark, sf_dir).select(F.from_json("body", fixtures.FIXTURE_SCHEMA).alias("f")).select("f.*")
    return fixtures.normalised(parsed).groupBy(F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT payload_id, count(*) AS games, max(bad) = 1 AS failed FROM (SELECT match_id // 10 AS payload_id, CAST(match_id % 97 = 0 AS INT) AS bad FROM m) GROUP BY payload_id""")
def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of several games: one game without a home side fails all of its payload."""
    m, k = bridge.matches(spark, sf_dir), F.col("match_id")
    name = lambda c: F.concat(F.lit("T"), F.col(c).cast("string"))
    game = F.struct(k.alias("id"), F.when(k % 97 != 0, name("home_team_id")).alias("home"), name("away_team_id").alias("away"), F.col("home_score").alias("home_points"), F.col("away_score").alias("away_points"))
    sent = m.groupBy(F.floor(k / 10).cast("long").alias("payload_id")).agg(F.collect_list(game).alias("games")).select(F.to_json(F.struct("payload_id", "games")).alias("body"))
    rows = fixtures.whole_payloads(sent.select(F.from_json("body", fixtures.PAYLOAD_SCHEMA).alias("p")).select("p.*"))
    return rows.groupBy("payload_id").agg(F.count(F.lit(1)).alias("games"), F.bool_or(F.col("reason").isNotNull()).alias("failed"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN match_id % 50 = 0 THEN 'data_mode_mock' WHEN match_id % 51 = 0 THEN 'missing_home_team' WHEN match_id % 53 = 0 THEN 'missing_away_team'
  WHEN status <> 'scheduled' THEN 'not_scheduled' WHEN match_id % 59 = 0 THEN 'scheduled_has_score' ELSE 'accepted' END AS reason FROM m) GROUP BY reason""")
def prematch_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rejection of each candidate for features before kickoff."""
    return rules.triage(candidates(spark, sf_dir), rules.prematch_rules(), "accepted")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches, some of them faulty."""
    k = F.col("match_id")
    return bridge.matches(spark, sf_dir).withColumns({
        "data_mode": F.when(k % 50 == 0, "mock").otherwise("live"), "home_team_id": F.when(k % 51 != 0, F.col("home_team_id")), "away_team_id": F.when(k % 53 != 0, F.col("away_team_id")),
        "home_score": F.when(k % 59 == 0, 1).otherwise(F.col("home_score")),
    })


@query("""SELECT match_id, CASE WHEN match_id % 50 = 0 THEN 'data_mode_mock' WHEN match_id % 51 = 0 THEN 'missing_home_team' WHEN match_id % 53 = 0 THEN 'missing_away_team' ELSE 'scheduled_has_score' END AS reason
FROM m WHERE status = 'scheduled' AND (match_id % 50 = 0 OR match_id % 51 = 0 OR match_id % 53 = 0 OR match_id % 59 = 0)""")
def reported_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejections that are reported: those of scheduled matches."""
    return rules.prematch_rejections(candidates(spark, sf_dir))


TRIAGE = """, tr AS (SELECT s.*, m.match_id IS NOT NULL AND m.season > 1993 AS inside, CASE WHEN bookmaker = 6 THEN 'mock' ELSE 'live' END AS mode, bookmaker = 5 AS odd_source, s.kickoff_at - INTERVAL 6 HOURS AS cutoff_at FROM s LEFT JOIN m USING (match_id))"""


@query(TRIAGE + """ SELECT snapshot_id, array_to_string(list_filter([CASE WHEN mode = 'mock' THEN 'mock_odds' END, CASE WHEN mode <> 'live' THEN 'non_live_data_mode' END, CASE WHEN odd_source THEN 'unexpected_provider' END, CASE WHEN NOT inside THEN 'outside_oos_universe' END,
  CASE WHEN away_odds IS NULL THEN 'incomplete_1x2' END, CASE WHEN available_at > cutoff_at THEN 'available_at_after_cutoff' END, CASE WHEN available_at > kickoff_at THEN 'post_kickoff' END], lambda x: x IS NOT NULL), ',') AS reasons FROM tr""")
def all_odds_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules that each snapshot fails by, in their order."""
    return backtest_odds(spark, sf_dir).select("snapshot_id", F.array_join(rules.all_reasons(backtest_rules()), ",").alias("reasons"))


@query(TRIAGE + " SELECT snapshot_id, match_id FROM tr WHERE mode = 'live' AND NOT odd_source AND inside AND away_odds IS NOT NULL AND available_at <= cutoff_at")
def accepted_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots that a backtest takes, once mock ones and those of another source have been kept out of the load."""
    clean = backtest_odds(spark, sf_dir).where("data_mode = 'live' AND source = 'odds-feed'")
    return rules.accepted(clean, backtest_rules()).select("snapshot_id", "match_id")


def backtest_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridge.matches(spark, sf_dir)
    universe = m.where("season > 1993").select("match_id", F.lit(True).alias("in_universe"))
    mode, source = F.when(F.col("bookmaker") == 6, "mock").otherwise("live"), F.when(F.col("bookmaker") == 5, "other").otherwise("odds-feed")
    return bridge.odds(spark, sf_dir, m).join(universe, "match_id", "left").withColumns({"data_mode": mode, "source": source, "cutoff_at": F.col("kickoff_at") - F.expr("INTERVAL 6 HOURS")})


def backtest_rules() -> list[rules.Rule]:
    return rules.odds_rules("odds-feed", F.col("away_odds").isNotNull())


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN bookmaker = 6 THEN 'unexpected_provider' WHEN available_at > kickoff_at THEN 'after_cutoff' WHEN away_odds IS NULL THEN 'incomplete_market' WHEN age_h > 24 THEN 'stale' ELSE 'eligible' END AS reason FROM s) GROUP BY reason""")
def odds_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot under the first rule that it fails by."""
    c = F.col
    chain = [rules.Rule("unexpected_provider", c("bookmaker") == 6), rules.Rule("after_cutoff", c("available_at") > c("kickoff_at")), rules.Rule("incomplete_market", c("away_odds").isNull()), rules.Rule("stale", c("age_h") > 24)]
    return rules.triage(bridge.odds(spark, sf_dir), chain)


@query("""SELECT match_id, CASE WHEN c <= k THEN k + INTERVAL 90 MINUTES ELSE c END AS result_at FROM (
  SELECT match_id, kickoff_at AS k, least(kickoff_at + to_hours(CAST(match_id % 6 AS INT) - 1), kickoff_at + INTERVAL 3 HOURS) AS c FROM m WHERE status = 'finished')""")
def result_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a result counts as known, from kickoff and collection."""
    m = bridge.matches(spark, sf_dir).where("status = 'finished'")
    collected = F.col("kickoff_at") + F.make_dt_interval(F.lit(0), (F.col("match_id") % 6).cast("int") - 1)
    return m.select("match_id", times.result_available_at(F.col("kickoff_at"), collected).alias("result_at"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS shown, round((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 1e6, 3) AS age_s FROM events")
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times cut to seconds, as text, and ages in seconds."""
    e = bridge.read(spark, sf_dir, "events")
    age = times.seconds_between(F.col("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return e.select("event_id", times.rfc3339(F.col("ts")).alias("shown"), F.round(age, 3).alias("age_s"))


@query("""SELECT league, season, chunk_start, least(chunk_start + INTERVAL 100 DAYS - INTERVAL 1 SECOND, b) AS chunk_end FROM (SELECT league, season, min(kickoff_at) AS a, max(kickoff_at) AS b FROM m GROUP BY league, season),
  LATERAL (SELECT unnest(generate_series(a, b, INTERVAL 100 DAYS)) AS chunk_start)""")
def request_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each season's range in chunks of a hundred days less a second."""
    spans = bridge.matches(spark, sf_dir).groupBy("league", "season").agg(F.min("kickoff_at").alias("a"), F.max("kickoff_at").alias("b"))
    return spans.select("league", "season", F.explode(times.day_chunks(F.col("a"), F.col("b"), 100)).alias("c")).select("league", "season", "c.chunk_start", "c.chunk_end")


SEASONS = ", se AS (SELECT league AS competition, season AS season_id, CAST(min(kickoff_at) AS DATE) AS starting_at, CAST(max(kickoff_at) AS DATE) AS ending_at FROM m GROUP BY league, season)"


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.matches(spark, sf_dir).groupBy(F.col("league").alias("competition"), F.col("season").alias("season_id")).agg(F.to_date(F.min("kickoff_at")).alias("starting_at"), F.to_date(F.max("kickoff_at")).alias("ending_at"))


@query(SEASONS + " SELECT competition, season_id FROM (SELECT *, row_number() OVER (PARTITION BY competition ORDER BY ending_at DESC, season_id) AS r FROM se) WHERE r <= 3")
def latest_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.season_selection(seasons(spark, sf_dir)).select("competition", "season_id")


@query(SEASONS + " SELECT competition, season_id FROM se WHERE starting_at <= DATE '1997-06-30' AND ending_at >= DATE '1996-03-01'")
def overlapping_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.season_selection(seasons(spark, sf_dir), start="1996-03-01", end="1997-06-30").select("competition", "season_id")


@query("SELECT match_id, CASE WHEN match_id % 3 = 0 THEN 'overlay' ELSE 'history' END AS origin FROM m")
def overlaid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of stores: what history doesn't have comes from the overlay."""
    ids = bridge.matches(spark, sf_dir).select("match_id")
    return readers.overlaid(ids.where("match_id % 3 <> 0").withColumn("origin", F.lit("history")), ids.where("match_id % 2 = 0 OR match_id % 3 = 0").withColumn("origin", F.lit("overlay")))


@query("SELECT event_id, sha256('event_type=' || event_type || chr(10) || 'user_id=' || user_id) AS checksum FROM events")
def stable_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of a payload's fields in key order, without those that change with every request."""
    e = bridge.read(spark, sf_dir, "events")
    payload = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("collected_at"), F.col("ts").cast("string"), F.lit("event_type"), F.col("event_type"))
    return e.select("event_id", intake.checksum(payload, ("collected_at",)).alias("checksum"))


@query("""SELECT match_id, selection, round(p - 1e0 / odds, 6) AS raw_edge, round(p - 1e0 / odds / overround, 6) AS fair_edge FROM (
  SELECT *, sum(1e0 / odds) OVER (PARTITION BY match_id) AS overround FROM (
    SELECT s1.match_id, unnest(['HOME', 'DRAW', 'AWAY']) AS selection, unnest([home_odds, draw_odds, away_odds]) AS odds, unnest([p_home, p_draw, p_away]) AS p
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY available_at DESC, snapshot_id DESC) AS r FROM s WHERE available_at <= kickoff_at) WHERE r = 1) s1 JOIN p ON p.match_id = s1.match_id) WHERE odds IS NOT NULL)""")
def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and fair edge of what the last snapshot offers: selections without odds are left out of the overround too."""
    m = bridge.matches(spark, sf_dir)
    last = asof.latest_odds(bridge.odds(spark, sf_dir, m), complete_only=False).join(bridge.predictions(m), "match_id")
    implied = [F.coalesce(O.implied(F.col(f"{s}_odds")), F.lit(0e0)) for s in ("home", "draw", "away")]
    over = implied[0] + implied[1] + implied[2]
    rows = F.explode(F.array(*(F.struct(F.lit(s.upper()).alias("selection"), F.col(f"{s}_odds").alias("odds"), F.col(f"p_{s}").alias("p")) for s in ("home", "draw", "away"))))
    flat = last.select("match_id", over.alias("overround"), rows.alias("v")).select("match_id", "overround", "v.*").where(F.col("odds").isNotNull())
    fair = F.col("p") - O.implied(F.col("odds")) / F.col("overround")
    return rounded(flat.select("match_id", "selection", O.edge(F.col("p"), F.col("odds")).alias("raw_edge"), fair.alias("fair_edge")), "raw_edge", "fair_edge")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?')) AS BIGINT) AS numbers FROM documents")
def number_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.read(spark, sf_dir, "documents").select("doc_id", F.size(X.numbers(F.col("text"))).cast("long").alias("numbers"))
