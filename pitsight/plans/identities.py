"""Team resolution in arrival order, against a recursion over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolution
from ..sources import bridge
from .registry import query

#: Arriving teams from the customers, in the order of their keys: ids, names and franchises recur, so that what a row
#: means depends on the rows before it. Components are kept small enough for a recursion by the pool that keys lie in.
ARRIVING = """, ar AS (SELECT c_custkey AS seq, chr(CAST(97 + c_custkey % 2 AS INT)) AS provider, 'i' || (c_custkey * 7 % 60) || '-' || c_custkey // 100 AS provider_id, 't' || c_custkey AS own_id, 'n' || (c_custkey * 13 % 40) || '-' || c_custkey // 100 AS name_key,
  c_custkey % 11 = 0 AS aliased, CASE WHEN c_custkey % 5 = 0 THEN 'f' || (c_custkey % 35) || '-' || c_custkey // 100 END AS franchise, 'f' || (c_custkey * 3 % 45) || '-' || c_custkey // 100 AS own_franchise, c_custkey * 13 % 40 = 6 AS several, c_custkey // 100 AS pool FROM customer),
pr AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY seq) AS place FROM ar),
rs AS (
  SELECT pool, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS provider, CAST(NULL AS VARCHAR) AS provider_id, CAST(NULL AS VARCHAR) AS canonical_id, CAST(NULL AS VARCHAR) AS method,
    CAST(MAP {} AS MAP(VARCHAR, VARCHAR)) AS known FROM (SELECT DISTINCT pool FROM pr)
  UNION ALL
  SELECT pool, place, seq, provider, provider_id, canonical_id, method,
    CASE WHEN method = 'ambiguous' THEN known ELSE map_concat(known, CASE WHEN method = 'provider_id' THEN CAST(MAP {} AS MAP(VARCHAR, VARCHAR)) ELSE MAP {'p' || provider || provider_id: canonical_id} END,
      MAP {name_key: coalesce(known[name_key], canonical_id)}, CASE WHEN method IN ('provider_id', 'historical_alias') THEN CAST(MAP {} AS MAP(VARCHAR, VARCHAR)) ELSE MAP {own_franchise: coalesce(known[own_franchise], canonical_id)} END) END
  FROM (SELECT *, CASE method WHEN 'provider_id' THEN by_id WHEN 'historical_alias' THEN by_franchise WHEN 'ambiguous' THEN NULL WHEN 'exact_id' THEN own_id ELSE by_name END AS canonical_id FROM (
    SELECT *, CASE WHEN by_id IS NOT NULL THEN 'provider_id' WHEN by_franchise IS NOT NULL THEN 'historical_alias' WHEN several THEN 'ambiguous' WHEN by_name IS NULL THEN 'exact_id' WHEN aliased THEN 'alias' ELSE 'normalized_name' END AS method FROM (
      SELECT pr.*, rs.known, rs.known['p' || pr.provider || pr.provider_id] AS by_id, rs.known[pr.franchise] AS by_franchise, rs.known[pr.name_key] AS by_name FROM rs JOIN pr ON pr.pool = rs.pool AND pr.place = rs.place + 1))))"""


def arriving(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    pool = F.floor(k / 100).cast("string")
    named = lambda letter, number: F.concat(F.lit(letter), number.cast("string"), F.lit("-"), pool)
    rows = bridge.read(spark, sf_dir, "customer").select(
        k.alias("seq"), F.when(k % 2 == 0, "a").otherwise("b").alias("provider"), named("i", k * 7 % 60).alias("provider_id"), F.concat(F.lit("t"), k.cast("string")).alias("own_id"), named("n", k * 13 % 40).alias("name_key"),
        (k % 11 == 0).alias("aliased"), F.when(k % 5 == 0, named("f", k % 35)).alias("franchise"), named("f", k * 3 % 45).alias("own_franchise"),
    )
    return rows, rows.where(F.col("name_key").startswith("n6-")).select("name_key")


@query(ARRIVING + " SELECT seq, provider, provider_id, canonical_id, method, CASE method WHEN 'normalized_name' THEN 0.95e0 WHEN 'ambiguous' THEN NULL ELSE 1e0 END AS confidence, CASE WHEN method = 'ambiguous' THEN 'quarantined' ELSE 'resolved' END AS status FROM rs WHERE place > 0")
def ordered_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every arriving team with the canonical id that the ones before it lead to."""
    return resolution.resolved_in_order(*arriving(spark, sf_dir)).drop("detail")


@query(ARRIVING + """ SELECT provider, provider_id, CASE WHEN method = 'ambiguous' THEN 'quarantined' ELSE 'resolved' END AS status, method, count(*) AS n, max(seq) AS seq, last(canonical_id ORDER BY seq) AS canonical_id
FROM rs WHERE place > 0 GROUP BY provider, provider_id, method""")
def resolution_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last diagnostic of each provider id, status and detail."""
    return resolution.diagnostics(resolution.resolved_in_order(*arriving(spark, sf_dir))).select("provider", "provider_id", "status", "method", "n", "seq", "canonical_id")
