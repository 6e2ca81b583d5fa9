"""Keys of competitions and franchises, recovery of odds for uncovered matches, page arithmetic, waits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import times
from ..operators import identity, slots, value
from ..sources import bridge
from .catalog import VALUES, values
from .intake import KEYS, keyed
from .registry import query

SPLIT = KEYS + ", sk AS (SELECT match_id, CASE match_id % 4 WHEN 0 THEN key || '|extra' WHEN 1 THEN replace(key, 'football|', '') ELSE key END AS key FROM ky), sp AS (SELECT *, string_split(key, '|') AS p FROM sk)"


@query(SPLIT + " SELECT match_id, CASE WHEN len(p) >= 4 THEN p[1] END AS sport, CASE WHEN len(p) >= 4 THEN p[2] END AS home, CASE WHEN len(p) >= 4 THEN p[3] END AS away, CASE WHEN len(p) >= 4 THEN array_to_string(p[4:], '|') END AS kickoff FROM sp")
def key_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural keys taken apart: some with the separator in the kickoff, some too short."""
    k = F.col("match_id") % 4
    key = F.when(k == 0, F.concat("key", F.lit("|extra"))).when(k == 1, F.replace("key", F.lit("football|"), F.lit(""))).otherwise(F.col("key"))
    return keyed(spark, sf_dir).select("match_id", X.key_parts(key).alias("p")).select("match_id", *(F.col(f"p.{c}").alias(c) for c in ("sport", "home", "away", "kickoff")))


SHOWN = ["Premier League", "premier-league", "MLS", "Major League Soccer", "Serie A", "premier league", "Eredivisie", "La Liga"]
SHOWN_SQL = "[" + ", ".join(f"'{n}'" for n in SHOWN) + "][CAST(match_id % 8 AS INT) + 1]"


@query(f"SELECT competition, count(*) AS n FROM (SELECT CASE name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.COMPETITIONS.items()) + f" ELSE name END AS competition FROM (SELECT {SHOWN_SQL} AS name FROM m)) GROUP BY competition")
def competition_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, SHOWN)), (F.col("match_id") % 8 + 1).cast("int"))
    return bridge.matches(spark, sf_dir).groupBy(X.competition(name).alias("competition")).agg(F.count(F.lit(1)).alias("n"))


FRANCHISE = """, fr AS (SELECT match_id, CASE WHEN match_id % 3 = 0 THEN 'mls' ELSE 'serie-a' END AS league, CAST(epoch(kickoff_at) AS BIGINT) AS t, kickoff_at, CASE WHEN match_id % 5 = 0 THEN 'fc-' ELSE 'team-' END || home_team_id AS home, 'team-' || away_team_id AS away FROM m),
fa AS (SELECT 'fc-' || team_id AS slug, 'team-' || team_id AS key FROM t WHERE team_id % 2 = 0),
fk AS (SELECT fr.*, CASE WHEN league = 'mls' THEN coalesce(h.key, home) ELSE home END AS home_key, CASE WHEN league = 'mls' THEN coalesce(a.key, away) ELSE away END AS away_key FROM fr LEFT JOIN fa h ON h.slug = home LEFT JOIN fa a ON a.slug = away)"""
EVENT_SQL = ", fe AS (SELECT match_id AS event_id, t + (match_id % 7 - 3) * 60 AS t, 'team-' || home_team_id AS home_key, 'team-' || CASE WHEN match_id % 9 = 0 THEN 19 ELSE away_team_id END AS away_key FROM (SELECT m.*, CAST(epoch(kickoff_at) AS BIGINT) AS t FROM m) WHERE match_id % 4 <> 0)"


def franchise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = bridge.matches(spark, sf_dir), F.col("match_id")
    rows = m.select(
        "match_id", F.when(k % 3 == 0, "mls").otherwise("serie-a").alias("league"), F.unix_seconds(F.col("kickoff_at").cast("timestamp")).alias("t"), "kickoff_at",
        F.concat(F.when(k % 5 == 0, "fc-").otherwise("team-"), F.col("home_team_id").cast("string")).alias("home"), F.concat(F.lit("team-"), F.col("away_team_id").cast("string")).alias("away"),
    )
    t = bridge.teams(spark, sf_dir).where("team_id % 2 = 0").select(F.concat(F.lit("fc-"), F.col("team_id").cast("string")).alias("slug"), F.concat(F.lit("team-"), F.col("team_id").cast("string")).alias("key"))
    return identity.franchise_keys(rows, t, ["home", "away"])


def franchise_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("match_id")
    away = F.when(k % 9 == 0, F.lit(19)).otherwise(F.col("away_team_id"))
    name = lambda c: F.concat(F.lit("team-"), c.cast("string"))
    return bridge.matches(spark, sf_dir).where(k % 4 != 0).select(k.alias("event_id"), (F.unix_seconds(F.col("kickoff_at").cast("timestamp")) + (k % 7 - 3) * 60).alias("t"), name(F.col("home_team_id")).alias("home_key"), name(away).alias("away_key"))


@query(FRANCHISE + " SELECT match_id, home_key, away_key, home_key <> home AS aliased FROM fk")
def franchise_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides by franchise in the one league that has such keys, by slug in the others."""
    return franchise_rows(spark, sf_dir).select("match_id", "home_key", "away_key", F.col("home_aliased").alias("aliased"))


@query(FRANCHISE + EVENT_SQL + " SELECT DISTINCT fk.match_id, fe.event_id FROM fk JOIN fe ON abs(fe.t - fk.t) <= 120 AND fe.home_key = fk.home_key AND fe.away_key = fk.away_key WHERE league = 'mls' AND fk.match_id % 8 <> 1")
def franchise_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncovered matches of the league for which an event of the same franchises begins within two minutes."""
    rows = franchise_rows(spark, sf_dir).where("league = 'mls' AND match_id % 8 <> 1")
    return identity.same_franchise_events(rows, franchise_events(spark, sf_dir))


UNALIGNED = ", ua AS (SELECT * FROM fk WHERE match_id % 8 <> 1 AND NOT EXISTS (SELECT 1 FROM fe WHERE fe.event_id % 50 = 2 AND abs(fe.t - fk.t) <= 120))"


@query(FRANCHISE + EVENT_SQL + UNALIGNED + " SELECT league, CAST(kickoff_at AS DATE) AS day, min(kickoff_at) AS slot_at, count(*) AS n FROM ua GROUP BY league, CAST(kickoff_at AS DATE) HAVING epoch(min(kickoff_at)) / 86400 % 5 <> 0")
def qualification_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot for each day with uncovered matches that no event aligns with, but for those asked for before."""
    rows = franchise_rows(spark, sf_dir)
    events = franchise_events(spark, sf_dir).where("event_id % 50 = 2")
    left = slots.unaligned(rows, events, rows.where("match_id % 8 = 1"))
    asked = rows.where(F.col("t") / 86400 % 5 == 0).select("league", F.col("kickoff_at").alias("slot_at"))
    return slots.day_slots(left, asked).select("league", "day", "slot_at", "n")


@query(KEYS + """, sg AS (SELECT match_id, home_team_id AS h, away_team_id AS a, split_part(key, '|', 2) AS hs, split_part(key, '|', 3) AS aws, split_part(key, '|', 4) AS at FROM ky JOIN m USING (match_id)),
la AS (SELECT team_id, 'land-' || team_id AS slug FROM t WHERE team_id % 3 = 0 UNION ALL SELECT team_id, 'isle-' || (team_id % 6) FROM t WHERE team_id % 4 = 0),
ho AS (SELECT match_id, hs AS s FROM sg UNION SELECT match_id, slug FROM sg JOIN la ON la.team_id = h), ao AS (SELECT match_id, aws AS s FROM sg UNION SELECT match_id, slug FROM sg JOIN la ON la.team_id = a),
ck AS (SELECT sg.match_id, 'football|' || ho.s || '|' || ao.s || '|' || sg.at AS key, CAST(ho.s <> hs OR ao.s <> aws AS INT) AS place FROM sg JOIN ho USING (match_id) JOIN ao USING (match_id))
SELECT key, match_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place, match_id) AS r FROM ck) WHERE r = 1""")
def alias_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by both sides' names and aliases; where two matches offer a key, an original one wins, then the first match."""
    k, t = keyed(spark, sf_dir), bridge.teams(spark, sf_dir)
    parts = X.key_parts(F.col("key"))
    m = bridge.matches(spark, sf_dir).select("match_id", "home_team_id", "away_team_id").join(k.select("match_id", parts.alias("p")), "match_id")
    rows = m.select("match_id", "home_team_id", "away_team_id", F.col("p.home").alias("home_slug"), F.col("p.away").alias("away_slug"), F.col("p.kickoff").alias("at"))
    of = lambda stem, c: F.concat(F.lit(stem), c.cast("string")).alias("slug")
    aliases = t.where("team_id % 3 = 0").select("team_id", of("land-", F.col("team_id"))).union(t.where("team_id % 4 = 0").select("team_id", of("isle-", F.col("team_id") % 6)))
    return identity.alias_keys(rows, aliases)


@query("SELECT attempt, retry_after, greatest(coalesce(CAST(retry_after AS DOUBLE), 0e0), least(8e0, 0.5e0 * pow(2e0, attempt))) AS wait, count(*) AS n FROM (SELECT event_id % 7 AS attempt, CASE WHEN event_id % 3 > 0 THEN event_id % 11 END AS retry_after FROM events) GROUP BY attempt, retry_after")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits before a repeated request, by attempt and what the provider asks for."""
    k = F.col("event_id")
    rows = bridge.read(spark, sf_dir, "events").select((k % 7).alias("attempt"), F.when(k % 3 > 0, k % 11).alias("retry_after"))
    return rows.groupBy("attempt", "retry_after").agg(F.count(F.lit(1)).alias("n")).withColumn("wait", times.backoff_seconds(F.col("attempt"), F.col("retry_after")))


@query("""SELECT total, lim, off, CAST(floor(off / sz) AS BIGINT) + 1 AS page, greatest(CAST(ceil(total / sz) AS BIGINT), 1) AS page_count, off > 0 AS has_previous, off + sz < total AS has_next, CASE WHEN total = 0 THEN 0 ELSE off + 1 END AS range_start, least(off + sz, total) AS range_end
FROM (SELECT DISTINCT event_id % 101 AS total, event_id % 13 AS lim, event_id % 17 AS off, greatest(event_id % 13, 1) AS sz FROM events)""")
def page_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = bridge.read(spark, sf_dir, "events").select((k % 101).alias("total"), (k % 13).alias("lim"), (k % 17).alias("off")).distinct()
    return rows.select("*", value.page_info(F.col("total"), F.col("lim"), F.col("off")).alias("p")).select("total", "lim", "off", "p.*")


@query(VALUES + """, pg AS (SELECT *, row_number() OVER (ORDER BY score DESC, ev DESC, edge DESC, freshness DESC, match_id, selection) AS pick_rank FROM g WHERE reason IS NULL)
SELECT count(*) AS displayed, arg_min(match_id, pick_rank) AS best_match, arg_min(selection, pick_rank) AS best_selection, round(avg(ev), 6) AS average_ev, round(avg(edge), 6) AS average_edge FROM pg WHERE pick_rank > 40 AND pick_rank <= 60""")
def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages and the best pick of the third page of twenty."""
    page = value.top_picks(value.gated(values(spark, sf_dir)).where(F.col("reason").isNull()), 20, 40)
    out = value.page_summary(page)
    return out.withColumns({c: F.round(c, 6) for c in ("average_ev", "average_edge")})


SORTED = " UNION ALL ".join(f"SELECT * FROM (SELECT '{s}' AS sort, match_id, selection, row_number() OVER (ORDER BY {c} DESC, match_id, selection) AS place FROM v) WHERE place <= 25" for s, c in (("edge", "edge"), ("ev", "ev"), ("probability", "p_sel"), ("odds", "odds")))


@query(VALUES + " " + SORTED)
def value_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the value table under each of its sorts: a top-k in every task, then numbers for what is left."""
    v, out = values(spark, sf_dir), None
    for sort, column in value.SORTS.items():
        first = value.sorted_values(v, sort).limit(25)
        place = F.row_number().over(Window.orderBy(F.desc(column), "match_id", "selection")).cast("long")
        one = first.select(F.lit(sort).alias("sort"), "match_id", "selection", place.alias("place"))
        out = one if out is None else out.union(one)
    return out
