"""A provider's bundle documents, written once a session from the domain tables, and what is taken from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bundle
from ..sources import bridge
from .intake import SLUG
from .registry import query
from .streams import stored

#: Matches of a document; when documents were collected; the league of their tables.
PER_DOCUMENT, COLLECTED, LEAGUE = 64, "2030-01-01 00:00:00", "Table League"
#: Documents are written in row groups of 64: a task reads up to 4,096 rows at once, but never over the end of a row group,
#: so that this bounds the texts that it holds, however large the files are.
ROW_GROUPS = {"parquet.block.row.count.limit": "64"}


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_id, collected_at, body): the documents."""
    return stored(spark, sf_dir, "bundles", _composed, ROW_GROUPS)


def _parts(x: Column) -> tuple[Column, Column, Column]:
    """The element of a match in a document's fixtures, in its table and in its injuries."""
    k, lit = x["match_id"], F.lit
    people = lambda i: F.struct(i.alias("id"), F.concat(lit("Player "), i.cast("string")).alias("name"))

    def event(e: Column) -> Column:
        part, supp, line = e["l_partkey"], e["l_suppkey"], e["l_linenumber"]
        return F.struct(
            F.struct(F.when(part % 29 == 0, "late").otherwise((line * 7).cast("string")).alias("elapsed")).alias("time"),
            F.struct(F.when(supp % 3 == 0, x["home_team_id"]).when(supp % 3 == 1, x["away_team_id"]).otherwise(999).alias("id")).alias("team"), F.when(supp % 5 != 0, people(part)).alias("player"),
            F.when(e["flag"] == "A", "Goal").when(e["flag"] == "R", "Own Goal").alias("type"), F.when(line % 2 == 1, F.concat(lit("Detail "), line.cast("string"))).alias("detail"),
        )

    player = lambda i, number, pos: F.struct(F.struct((k * 10 + i).alias("id"), F.concat(lit("Player "), (k * 10 + i).cast("string")).alias("name"), number.alias("number"), pos.alias("pos")).alias("player"))
    lineup = lambda team, i: F.struct(F.struct(team.alias("id")).alias("team"), F.when(k % 4 != 0, "4-4-2").alias("formation"), F.array(player(i, F.when(k % 31 == 0, "nine").otherwise("9"), lit("F"))).alias("startXI"), F.array(player(i + 1, lit(None).cast("string"), lit(None).cast("string"))).alias("substitutes"))
    stat = lambda name, value: F.struct(lit(name).alias("type"), value.cast("string").alias("value"))
    stats = lambda team, score: F.struct(F.struct(team.alias("id")).alias("team"), F.array(stat("Shots on Goal", score), stat("Ball Possession", F.when(k % 9 == 0, "half"))).alias("statistics"))
    either = lambda day, column: F.when(k % day == 0, 999).otherwise(x[column])
    fixture = F.struct(
        F.struct(
            F.when(k % 17 != 0, k).alias("id"), F.when(k % 13 == 0, "soon").otherwise(F.date_format(x["kickoff_at"], "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("date"),
            F.struct(F.when(k % 11 == 0, "XX").when(x["status"] == "finished", "FT").otherwise("NS").alias("short")).alias("status"), F.struct(F.when(k % 2 == 0, F.concat(lit("Ground "), (k % 50).cast("string"))).alias("name")).alias("venue"),
        ).alias("fixture"),
        F.struct(lit(39).alias("id"), x["league"].alias("name"), lit("Land").alias("country"), x["season"].alias("season")).alias("league"),
        F.struct(F.struct(x["home_team_id"].alias("id"), x["home_name"].alias("name")).alias("home"), F.struct(x["away_team_id"].alias("id"), F.when(k % 19 != 0, x["away_name"]).alias("name")).alias("away")).alias("teams"),
        F.struct(F.when(k % 23 == 0, "two").otherwise(x["home_score"].cast("string")).alias("home"), x["away_score"].alias("away")).alias("goals"),
        F.transform(x["events"], event).alias("events"), F.array(lineup(x["home_team_id"], 1), lineup(either(7, "away_team_id"), 3)).alias("lineups"), F.array(stats(x["home_team_id"], x["home_score"]), stats(either(5, "away_team_id"), x["away_score"])).alias("statistics"),
    )
    row = F.struct(k.alias("rank"), F.struct(x["home_team_id"].alias("id"), x["home_name"].alias("name")).alias("team"), F.when(k % 21 == 0, "many").otherwise(x["home_score"].cast("string")).alias("points"), x["away_score"].alias("lose"))
    injury = F.struct(
        F.when(k % 33 != 0, F.concat(lit("i"), k.cast("string"))).alias("id"), F.when(k % 27 != 0, people(k)).alias("player"), F.struct(x["home_team_id"].alias("id")).alias("team"), F.when(k % 2 == 0, "Knee").alias("type"),
        F.element_at(F.array(lit("injured"), lit("doubtful"), lit("limping"), lit(None)), (k % 4 + 1).cast("int")).alias("status"), F.date_format(x["kickoff_at"], "yyyy-MM-dd HH:mm:ss").alias("observed_at"),
    )
    return fixture, row, injury


def _composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 matches a document, in order of their ids; by divisors of the ids, some elements have faults of every kind.

    Only the tables' own columns are shuffled; elements are built from them in the document's task, as they take many
    times as much."""
    m, t = bridge.matches(spark, sf_dir), bridge.teams(spark, sf_dir)
    for side in ("home", "away"):
        m = m.join(F.broadcast(t.select(F.col("team_id").alias(f"{side}_team_id"), F.col("team_name").alias(f"{side}_name"))), f"{side}_team_id")
    # Dealt by the match, both groupings need no other shuffle.
    items = bridge.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").repartition("l_orderkey")
    items = items.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("flag"))
    of_match = items.groupBy(F.col("l_orderkey").alias("match_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "flag"))).alias("events"))
    match = F.struct("match_id", "kickoff_at", "home_team_id", "away_team_id", "home_name", "away_name", "league", "season", "status", "home_score", "away_score", "events")
    number = F.floor(F.col("match_id") / PER_DOCUMENT).cast("long").alias("number")
    grouped = m.join(of_match, "match_id").groupBy(number).agg(F.sort_array(F.collect_list(match)).alias("of"))
    table = F.array(F.struct(F.lit("2024").alias("season"), F.lit("2024-05-01T10:00:00Z").alias("as_of"), F.transform("of", lambda x: _parts(x)[1]).alias("table")))
    injuries = F.transform(F.filter("of", lambda x: x["match_id"] % 3 == 0), lambda x: _parts(x)[2])
    text = F.to_json(F.struct(F.lit("mock").alias("data_mode"), F.transform("of", lambda x: _parts(x)[0]).alias("response"), table.alias("standings"), injuries.alias("injuries")))
    body = F.when(F.col("number") % 37 == 5, F.left(text, F.length(text) - 5)).when(F.col("number") % 41 == 7, F.concat(F.lit('{"response": 7, "injuries": null}'))).otherwise(text)
    return grouped.select(F.concat(F.lit("b"), F.col("number").cast("string")).alias("raw_id"), F.lit(COLLECTED).cast("timestamp_ntz").alias("collected_at"), body.alias("body"))


LGE = "'lge_football-' || " + SLUG.format(x="league") + " || '-' || season"
#: The documents' matches with their place, and the league under which a document first names a team; then each kind of
#: element with its reason.
BUNDLE = f""", q AS (SELECT * FROM (SELECT *, match_id // 64 AS number, 'b' || (match_id // 64) AS raw_id, row_number() OVER (PARTITION BY match_id // 64 ORDER BY match_id) - 1 AS pos, {LGE} AS lge FROM m) WHERE number % 37 <> 5 AND number % 41 <> 7),
f AS (SELECT q.*, h.team_name AS home_name, a.team_name AS away_name, 'response[' || pos || ']' AS path, CASE WHEN match_id % 17 = 0 THEN 'missing_provider_id' WHEN match_id % 11 = 0 THEN 'unknown_status' WHEN match_id % 13 = 0 THEN 'bad_time'
  WHEN match_id % 19 = 0 THEN 'missing_participant' WHEN match_id % 23 = 0 THEN 'invalid_number' END AS reason FROM q JOIN t h ON h.team_id = home_team_id JOIN t a ON a.team_id = away_team_id),
nm AS (SELECT raw_id, team, name, first(lge ORDER BY match_id) AS lge FROM (SELECT raw_id, match_id, home_team_id AS team, home_name AS name, lge FROM f UNION ALL SELECT raw_id, match_id, away_team_id, away_name, lge FROM f WHERE match_id % 19 <> 0) GROUP BY ALL),
tm AS (SELECT raw_id, team, 'tm_football-' || {SLUG.format(x="name")} || '-' || replace(lge, '_', '-') AS id FROM nm),
li AS (SELECT l_orderkey AS match_id, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
ev AS (SELECT f.*, part, supp, line, flag, f.path || '.events[' || (row_number() OVER (PARTITION BY f.match_id ORDER BY line, part, supp) - 1) || ']' AS spot, CASE supp % 3 WHEN 0 THEN home_team_id WHEN 1 THEN away_team_id END AS side,
  CASE WHEN reason IS NOT NULL THEN 'rejected_parent' WHEN flag NOT IN ('A', 'R') THEN 'invalid_payload' WHEN part % 29 = 0 THEN 'invalid_number' END AS why FROM f JOIN li ON li.match_id = f.match_id),
sd AS (SELECT f.*, s.i, CASE WHEN s.i = 0 THEN home_team_id ELSE away_team_id END AS side FROM f, (SELECT unnest([0, 1]) AS i) s),
lu AS (SELECT sd.*, tm.id AS team, path || '.lineups[' || i || ']' AS spot, CASE WHEN reason IS NOT NULL THEN 'rejected_parent' WHEN i = 1 AND match_id % 7 = 0 THEN 'missing_provider_id' END AS why FROM sd LEFT JOIN tm ON tm.raw_id = sd.raw_id AND tm.team = sd.side),
pl AS (SELECT lu.*, r.role, match_id * 10 + 1 + 2 * i + r.role AS player, CASE WHEN r.role = 0 AND match_id % 31 = 0 THEN 'invalid_number' END AS bad FROM lu, (SELECT unnest([0, 1]) AS role) r WHERE why IS NULL),
sb AS (SELECT sd.*, tm.id AS team, path || '.statistics[' || i || ']' AS spot, CASE WHEN reason IS NOT NULL THEN 'rejected_parent' WHEN i = 1 AND match_id % 5 = 0 THEN 'missing_provider_id' END AS why FROM sd LEFT JOIN tm ON tm.raw_id = sd.raw_id AND tm.team = sd.side),
sx AS (SELECT sb.*, k.k, CASE WHEN k.k = 0 THEN CASE WHEN i = 0 THEN home_score ELSE away_score END END AS value, CASE WHEN k.k = 1 AND match_id % 9 = 0 THEN 'invalid_number' END AS bad FROM sb, (SELECT unnest([0, 1]) AS k) k WHERE why IS NULL),
sg AS (SELECT f.*, 'standings[0].table[' || pos || ']' AS spot, CASE WHEN match_id % 21 = 0 THEN 'invalid_number' END AS why FROM f),
ij AS (SELECT *, 'injuries[' || (row_number() OVER (PARTITION BY raw_id ORDER BY match_id) - 1) || ']' AS spot, CASE WHEN match_id % 27 = 0 THEN 'invalid_payload' WHEN match_id % 4 = 2 THEN 'unknown_status' WHEN match_id % 33 = 0 THEN 'missing_provider_id' END AS why FROM f WHERE match_id % 3 = 0)"""


def _taken(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNull()).drop("reason")


@query(BUNDLE + f""" SELECT f.raw_id, path, 'mth_football-' || match_id AS match_id, CAST(match_id AS VARCHAR) AS provider_id, kickoff_at, status, f.lge AS league_id, CAST(season AS VARCHAR) AS season,
  'tm_football-' || {SLUG.format(x="home_name")} || '-' || replace(f.lge, '_', '-') AS home_team_id, 'tm_football-' || {SLUG.format(x="away_name")} || '-' || replace(f.lge, '_', '-') AS away_team_id,
  CAST(home_score AS BIGINT) AS home_score, CAST(away_score AS BIGINT) AS away_score, CASE WHEN match_id % 2 = 0 THEN 'Ground ' || (match_id % 50) END AS venue,
  'football|' || {SLUG.format(x="home_name")} || '|' || {SLUG.format(x="away_name")} || '|' || strftime(kickoff_at, '%Y-%m-%dT%H:%M:%SZ') AS natural_key, CASE WHEN status = 'finished' THEN kickoff_at ELSE TIMESTAMP '{COLLECTED}' END AS available_at FROM f WHERE reason IS NULL""")
def bundle_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taken(bundle.fixtures(written(spark, sf_dir)))


@query(BUNDLE + """ SELECT ev.raw_id, spot AS path, 'evt_football-' || match_id || '-' || (line * 7) || '-' || CASE WHEN supp % 5 = 0 THEN 'none' ELSE CAST(part AS VARCHAR) END AS event_id, 'mth_football-' || match_id AS match_id, CASE flag WHEN 'A' THEN 'goal' ELSE 'own-goal' END AS event_type,
  CASE WHEN line % 2 = 1 THEN 'Detail ' || line WHEN flag = 'A' THEN 'Goal' ELSE 'Own Goal' END AS label, CAST(line * 7 AS BIGINT) AS minute, tm.id AS team_id, CASE WHEN supp % 5 <> 0 THEN 'plr_football-player-' || part || '-' || part END AS player_id, kickoff_at AS available_at
FROM ev LEFT JOIN tm ON tm.raw_id = ev.raw_id AND tm.team = ev.side WHERE why IS NULL""")
def bundle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taken(bundle.events(written(spark, sf_dir)))


@query(BUNDLE + """ SELECT raw_id, spot || CASE WHEN role = 0 THEN '.startXI[0]' ELSE '.substitutes[0]' END AS path, 'lnp_mth-football-' || match_id || '-' || replace(team, '_', '-') AS lineup_id, 'mth_football-' || match_id AS match_id, team AS team_id,
  CASE WHEN match_id % 4 <> 0 THEN '4-4-2' END AS formation, 'plr_football-player-' || player || '-' || player AS player_id, CASE WHEN role = 0 THEN 'starter' ELSE 'bench' END AS role, CAST(CASE WHEN role = 0 THEN 9 END AS BIGINT) AS jersey_number, CASE WHEN role = 0 THEN 'F' END AS position,
  kickoff_at - INTERVAL 1 HOUR AS available_at FROM pl WHERE bad IS NULL""")
def bundle_lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taken(bundle.lineups(written(spark, sf_dir)))


@query(BUNDLE + """ SELECT raw_id, spot || '.statistics[' || k || ']' AS path, 'mth_football-' || match_id AS match_id, team AS team_id, CAST(season AS VARCHAR) AS season, CASE k WHEN 0 THEN 'shots-on-goal' ELSE 'ball-possession' END AS stat_key, CASE k WHEN 0 THEN 'Shots on Goal' ELSE 'Ball Possession' END AS label,
  CASE WHEN value IS NULL THEN 'unavailable' ELSE 'available' END AS availability, CAST(value AS DOUBLE) AS value, kickoff_at AS as_of FROM sx WHERE bad IS NULL""")
def bundle_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taken(bundle.statistics(written(spark, sf_dir))).withColumn("value", F.col("value").cast("double"))


@query(BUNDLE + f""" SELECT raw_id, spot AS path, 'lge_football-table-league-2024' AS league_id, '2024' AS season, 'tm_football-' || {SLUG.format(x="home_name")} || '-lge-football-table-league-2024' AS team_id, TIMESTAMP '2024-05-01 10:00:00' AS as_of, match_id AS rank,
  CAST(home_score AS BIGINT) AS points, CAST(NULL AS BIGINT) AS played, CAST(NULL AS BIGINT) AS won, CAST(NULL AS BIGINT) AS drawn, CAST(away_score AS BIGINT) AS lost, CAST(NULL AS BIGINT) AS goals_for, CAST(NULL AS BIGINT) AS goals_against FROM sg WHERE why IS NULL""")
def bundle_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taken(bundle.standings(written(spark, sf_dir), LEAGUE))


@query(BUNDLE + """ SELECT raw_id, spot AS path, 'inj_i' || match_id AS injury_id, 'plr_football-player-' || match_id || '-' || match_id AS player_id, CAST(home_team_id AS VARCHAR) AS team_provider_id, CASE match_id % 4 WHEN 0 THEN 'injured' WHEN 1 THEN 'doubtful' ELSE 'unknown' END AS status,
  CASE WHEN match_id % 2 = 0 THEN 'Knee' END AS description, kickoff_at AS available_at FROM ij WHERE why IS NULL""")
def bundle_injuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taken(bundle.injuries(written(spark, sf_dir)))


@query(BUNDLE + """ SELECT DISTINCT 'b' || (match_id // 64) AS raw_id, 'document' AS entity_type, CASE WHEN match_id // 64 % 37 = 5 THEN '$' ELSE 'response' END AS path, CASE WHEN match_id // 64 % 37 = 5 THEN 'invalid_json' ELSE 'invalid_payload' END AS reason
  FROM m WHERE match_id // 64 % 37 = 5 OR match_id // 64 % 41 = 7
UNION ALL SELECT raw_id, 'fixture', path, reason FROM f WHERE reason IS NOT NULL UNION ALL SELECT raw_id, 'event', spot, why FROM ev WHERE why IS NOT NULL
UNION ALL SELECT raw_id, 'lineup', spot, why FROM lu WHERE why IS NOT NULL UNION ALL SELECT raw_id, 'lineup', spot || '.startXI[0]', bad FROM pl WHERE bad IS NOT NULL
UNION ALL SELECT raw_id, 'statistic', spot, why FROM sb WHERE why IS NOT NULL UNION ALL SELECT raw_id, 'statistic', spot || '.statistics[1]', bad FROM sx WHERE bad IS NOT NULL
UNION ALL SELECT raw_id, 'standing', spot, why FROM sg WHERE why IS NOT NULL UNION ALL SELECT raw_id, 'injury', spot, why FROM ij WHERE why IS NOT NULL""")
def bundle_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element that isn't taken, with its path and reason."""
    return bundle.rejected(written(spark, sf_dir), LEAGUE)
