"""Keyed tables written batch by batch, with quarantine, run log and two sinks of one stream, against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical
from ..session import new_folder
from ..sources import bridge, lookup
from ..sources.keyed import Intake, KeyedTable, tee
from ..streaming import streams
from .registry import query
from .streams import SCHEMA

#: The events arrive in three batches, by id; in each in order of time and id.
BATCHES = 3
KEYED = "user_id long, event_type string, first_event long, last_event long, big boolean"
ARRIVALS = f""", ar AS (SELECT *, event_id % {BATCHES} AS b, value > 50 AS big FROM events),
ky AS (SELECT user_id, event_type, b, first(event_id ORDER BY ts, event_id) AS first_event, last(event_id ORDER BY ts, event_id) AS last_event, last(big ORDER BY ts, event_id) AS big, count(*) AS n FROM ar GROUP BY ALL)"""


def _arriving(spark: SparkSession, sf_dir: str, batch: int) -> DataFrame:
    e = bridge.read(spark, sf_dir, "events").where(F.col("event_id") % BATCHES == batch)
    return e.select("user_id", "event_type", F.col("event_id").alias("first_event"), F.col("event_id").alias("last_event"), (F.col("value") > 50).alias("big"), "ts", "event_id")


@query(ARRIVALS + """ SELECT user_id, event_type, first(first_event ORDER BY b) AS first_event, last(last_event ORDER BY b) AS last_event, last(big ORDER BY b) AS big FROM ky GROUP BY user_id, event_type""")
def keyed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches into a stored table: what a key came with first stays in first_event, the other columns are set anew."""
    table = KeyedTable.create(spark, f"{new_folder(spark)}/keyed", KEYED, ["user_id", "event_type"], buckets=16)
    for batch in range(BATCHES):
        table.upsert(_arriving(spark, sf_dir, batch), ["ts", "event_id"], ["last_event", "big"])
    return table.read()


@query(ARRIVALS + """, mv AS (SELECT *, lag(big) OVER w IS DISTINCT FROM big AS moved, row_number() OVER w AS r FROM ky WINDOW w AS (PARTITION BY user_id, event_type ORDER BY b))
SELECT CAST(b AS BIGINT) AS batch, count(*) FILTER (WHERE r = 1) AS inserted, count(*) FILTER (WHERE r > 1 AND moved) AS changed, CAST(sum(n) AS BIGINT) AS offered FROM mv GROUP BY b""")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New keys, stored rows with another flag, and offered rows of each batch; every batch is offered twice, which its
    number makes harmless."""
    table = KeyedTable.create(spark, f"{new_folder(spark)}/keyed", "user_id long, event_type string, big boolean", ["user_id", "event_type"], buckets=16)
    rows = []
    for batch in range(BATCHES):
        for _ in range(2):
            written = table.upsert(_arriving(spark, sf_dir, batch), ["ts", "event_id"], ["big"], ("events", batch))
        rows.append((batch, written.inserted, written.changed, written.offered))
    return spark.createDataFrame(rows, "batch long, inserted long, changed long, offered long")


REFUSED = """, bu AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 60),
rf AS (SELECT event_id, user_id, event_id % 3 AS b, CASE WHEN value <= 5 THEN 'low_value' WHEN CAST(json_extract(props, '$.k') AS INT) % 7 = 0 THEN 'seventh_key' WHEN user_id NOT IN (SELECT user_id FROM bu) THEN 'missing_parent' END AS reason FROM events)"""


def _taken_in(spark: SparkSession, sf_dir: str) -> Intake:
    """The events in three runs: two rules and a missing parent refuse some of them."""
    events = bridge.read(spark, sf_dir, "events")
    buyers = events.where("event_type = 'purchase' AND value > 60")
    reason = F.when(F.col("value") <= 5, "low_value").when(F.from_json("props", "k int")["k"] % 7 == 0, "seventh_key")
    into = Intake.create(spark, f"{new_folder(spark)}/intake", "event_id long, user_id long, event_type string, value double", ["event_id"], buckets=16)
    for batch in range(BATCHES):
        run = {"run_id": f"run-{batch}", "provider": "events", "resource_type": "event", "data_mode": "live", "batch": batch}
        into.run(events.where(F.col("event_id") % BATCHES == batch), reason, run, ["event_id"], entity_id=F.col("event_id"), detail=F.concat(F.lit("value "), F.col("value").cast("string")), parents=(buyers, "user_id"))
    return into


@query(REFUSED + " SELECT 'run-' || b AS run_id, reason AS reason_code, CAST(event_id AS VARCHAR) AS provider_entity_id FROM rf WHERE reason IS NOT NULL")
def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three runs refused, and why."""
    return _taken_in(spark, sf_dir).quarantine.read().select("run_id", "reason_code", "provider_entity_id")


@query(REFUSED + """ SELECT 'run-' || b AS run_id, 'partial' AS status, count(*) AS records_read, count(*) FILTER (WHERE reason IS NULL) AS records_accepted, count(reason) AS records_quarantined FROM rf GROUP BY b""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taken_in(spark, sf_dir).runs.read().select("run_id", "status", "records_read", "records_accepted", "records_quarantined")


@query("""SELECT 'event' AS sink, event_id AS key, value FROM events UNION ALL
SELECT 'user', user_id, last(value ORDER BY event_id) FROM events GROUP BY user_id""")
def stream_tee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of three files into two keyed tables in one pass: every event, and each user's last one by id."""
    folder = new_folder(spark)
    events = bridge.read(spark, sf_dir, "events")
    events.repartitionByRange(3, "event_id").write.parquet(f"{folder}/in")
    every = KeyedTable.create(spark, f"{folder}/every", "event_id long, value double", ["event_id"], buckets=16)
    last = KeyedTable.create(spark, f"{folder}/last", "user_id long, event_id long, value double", ["user_id"], buckets=16)

    def to_last(rows: DataFrame, batch: tuple[str, int]) -> None:
        # Files come in any order: a user's row is set only by later events than the one it has.
        held = rows.select("user_id", "event_id", "value").unionByName(last.lookup(rows))
        last.upsert(held, ["event_id"], ["event_id", "value"], batch)

    both = tee("events", lambda rows, batch: every.upsert(rows, ["event_id"], batch=batch), to_last)
    stream = streams.event_stream(spark, f"{folder}/in", SCHEMA)
    stream.writeStream.foreachBatch(both).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    every_rows = every.read().select(F.lit("event").alias("sink"), F.col("event_id").alias("key"), "value")
    return every_rows.unionByName(last.read().select(F.lit("user").alias("sink"), F.col("user_id").alias("key"), "value"))


@query(""", sel AS (SELECT match_id, snapshot_id, available_at, bookmaker, string_agg(selection || '=' || CAST(CAST(round(odds * 100) AS BIGINT) AS VARCHAR), ' ' ORDER BY selection) AS picks FROM (
    SELECT *, unnest(['HOME', 'DRAW', 'AWAY']) AS selection, unnest([home_odds, draw_odds, away_odds]) AS odds FROM s) WHERE odds IS NOT NULL AND snapshot_id % 10 <> 3 GROUP BY ALL)
SELECT m.match_id, r_name AS league, h.team_name AS home_team, a.team_name AS away_team, count(snapshot_id) AS n_snapshots, coalesce(string_agg(snapshot_id || ':' || bookmaker || ':' || picks, ';' ORDER BY sel.available_at, snapshot_id), '') AS snapshots
FROM m LEFT JOIN sel ON sel.match_id = m.match_id LEFT JOIN region ON r_regionkey = m.match_id % 7 JOIN t h ON h.team_id = home_team_id JOIN t a ON a.team_id = away_team_id GROUP BY ALL""")
def canonical_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical tables as nested matches, shown as text: every tenth snapshot has no selections, two leagues in seven
    have no row."""
    m = bridge.matches(spark, sf_dir).drop("league").withColumn("league_id", F.col("match_id") % 7)
    s = bridge.odds(spark, sf_dir, m)
    prices = F.explode(F.array(*(F.struct(F.lit(n.upper()).alias("selection"), F.col(f"{n}_odds").alias("decimal_odds")) for n in ("home", "draw", "away")))).alias("x")
    selections = s.where("snapshot_id % 10 <> 3").select("snapshot_id", prices).select("snapshot_id", "x.*").where("decimal_odds IS NOT NULL")
    leagues = bridge.read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("league_id"), F.lit(1).alias("sport_id"), F.col("r_name").alias("name"))
    sports = leagues.select("sport_id", F.lit("football").alias("code")).distinct()
    rows = canonical.canonical(sports, leagues, bridge.teams(spark, sf_dir), m, s, selections)
    picks = lambda x: F.array_join(F.transform(x["selections"], lambda p: F.concat(p["selection"], F.lit("="), F.round(p["decimal_odds"] * 100).cast("long").cast("string"))), " ")
    shown = F.transform("snapshots", lambda x: F.concat(x["snapshot_id"].cast("string"), F.lit(":"), x["bookmaker"].cast("string"), F.lit(":"), picks(x)))
    return rows.select("match_id", "league", "home_team", "away_team", F.size("snapshots").cast("long").alias("n_snapshots"), F.array_join(shown, ";").alias("snapshots"))


@query("SELECT match_id, kickoff_at, home_team_id, away_team_id, home_score FROM m WHERE match_id IN (SELECT match_id FROM m WHERE status = 'finished' ORDER BY kickoff_at DESC, match_id DESC LIMIT 8)")
def stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest eight finished matches, looked up by their ids in a store of all matches."""
    path, m = f"{new_folder(spark)}/store", bridge.matches(spark, sf_dir)
    lookup.write_store(m, path)
    newest = m.where("status = 'finished'").orderBy(F.desc("kickoff_at"), F.desc("match_id")).limit(8)
    ids = [r["match_id"] for r in newest.select("match_id").collect()]
    return lookup.labelled(spark, path, ids, ("home_score",)).select("match_id", "kickoff_at", "home_team_id", "away_team_id", "home_score")
