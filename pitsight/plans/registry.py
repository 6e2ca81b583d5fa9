"""Registry of named queries and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The domain tables of sources.bridge in SQL.
DOMAIN = """
WITH RECURSIVE m AS (
  SELECT o_orderkey AS match_id, o_orderdate AS kickoff_at, o_custkey % 20 AS home_team_id,
         (o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS away_team_id, o_orderpriority AS league,
         CAST(year(o_orderdate) AS INT) AS season,
         CASE WHEN o_orderstatus = 'P' THEN 'scheduled' ELSE 'finished' END AS status,
         CASE WHEN o_orderstatus <> 'P' THEN h END AS home_score,
         CASE WHEN o_orderstatus <> 'P' THEN a END AS away_score,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 3 HOURS END AS available_at
  FROM orders JOIN (
    SELECT l_orderkey, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS INT) AS h,
           CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS INT) AS a
    FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
s AS (
  SELECT *, kickoff_at - to_hours(age_h) AS available_at FROM (
    SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS snapshot_id, match_id, kickoff_at,
           l_suppkey % 7 AS bookmaker,
           CAST(l_linenumber * 6 - 6 - CASE WHEN l_suppkey % 5 = 0 THEN 12 ELSE 0 END AS INT) AS age_h,
           (105 + l_partkey % 400) / 100e0 AS home_odds, (205 + l_suppkey % 300) / 100e0 AS draw_odds,
           CASE WHEN l_partkey % 10 <> 0 THEN (105 + (l_partkey * 7 + l_suppkey) % 500) / 100e0 END AS away_odds
    FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem) JOIN m ON l_orderkey = match_id)),
t AS (
  SELECT CAST(n_nationkey AS BIGINT) AS team_id, 'Nation ' || split_part(n_name, '_', 2) AS team_name,
         CAST(n_regionkey AS BIGINT) AS region_id FROM nation WHERE n_nationkey < 20),
d AS (
  SELECT match_id, (home_team_id - away_team_id) * 15e0 AS diff,
         1e0 / (1e0 + pow(10e0, -(((home_team_id - away_team_id) * 15e0 + 80e0) / 400e0))) AS e,
         least(greatest(0.26e0 * exp(-0.8e0 * abs((home_team_id - away_team_id) * 15e0) / 400e0), 0.05e0), 0.42e0) AS dr FROM m),
p AS (
  SELECT match_id, (1e0 - dr) * e / tot AS p_home, dr / tot AS p_draw, (1e0 - dr) * (1e0 - e) / tot AS p_away
  FROM (SELECT *, (1e0 - dr) * e + dr + (1e0 - dr) * (1e0 - e) AS tot FROM d)),
lo AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY available_at DESC, snapshot_id DESC) AS r
    FROM s WHERE available_at <= kickoff_at AND away_odds IS NOT NULL) WHERE r = 1)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql may begin with a domain table (then DOMAIN goes before it)."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            ORACLES[f.__name__] = f"{DOMAIN.strip()}{text}" if text.startswith(",") else f"{DOMAIN.strip()}\n{text}"
        return f

    return register
