"""Point lookups: feature files that are ordered by their key and carry Bloom filters, read a few row groups at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group, and keys up to which a lookup names them in the scan's filter.
GROUP_BYTES, NAMED = 4 << 20, 10_000


def write_store(rows: DataFrame, path: str, key: str = "match_id", files: int | None = None, group_bytes: int = GROUP_BYTES) -> None:
    """Rows in ranges of the key, ordered by it in each file, with a Bloom filter of the key in each row group: a lookup
    passes files and row groups by over their bounds, and within the bounds those that lack the key. Ranges come from a
    sample, so that files are of near equal size; rows of one key lie together."""
    placed = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    out = placed.sortWithinPartitions(key).write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", str(group_bytes))
    out.option("parquet.page.size", str(min(group_bytes // 4, 1 << 20))).parquet(path)


def lookup(spark: SparkSession, path: str, ids: list[int], key: str = "match_id") -> DataFrame:
    """The rows of the given keys, repeats once. Each key is an equality in the scan's filter, whose row groups are passed
    by on bounds and Bloom filters; so many that the plan would grow are looked up by a join instead."""
    wanted = sorted({i for i in ids if i is not None})
    rows = spark.read.parquet(path)
    if len(wanted) > NAMED:
        return lookup_all(spark, path, spark.createDataFrame([(i,) for i in wanted], f"{key} long"), key)
    # As disjunctions of equalities: the scan checks each of them, where a long list is only its smallest and largest.
    return rows.where(_any_of(key, wanted)) if wanted else rows.limit(0)


def lookup_all(spark: SparkSession, path: str, ids: DataFrame, key: str = "match_id") -> DataFrame:
    """The rows of all keys in ids, as a semi-join; the scan is bounded by the smallest and largest of them."""
    low, high = ids.agg(F.min(key), F.max(key)).first()
    rows = spark.read.parquet(path)
    if low is None:
        return rows.limit(0)
    return rows.where((F.col(key) >= low) & (F.col(key) <= high)).join(ids.select(key).distinct(), key, "left_semi")


def labelled(spark: SparkSession, path: str, ids: list[int], labels: tuple[str, ...], key: str = "match_id") -> DataFrame:
    """The rows of the given keys that have a label: history, not what is still to come."""
    rows = lookup(spark, path, ids, key)
    for name in labels:
        rows = rows.where(F.col(name).isNotNull())
    return rows


def _any_of(key: str, ids: list[int]):
    """A balanced tree of equalities, so that no plan gets deeper than the logarithm of their number."""
    if len(ids) == 1:
        return F.col(key) == ids[0]
    half = len(ids) // 2
    return _any_of(key, ids[:half]) | _any_of(key, ids[half:])


def scanned_rows(df: DataFrame) -> int:
    """Rows that the scans of a collected frame have read, after row groups were passed by: for tests and reports."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        while leaf.nodeName() in ("AdaptiveSparkPlan", "ResultQueryStage"):
            leaf = leaf.executedPlan() if leaf.nodeName() == "AdaptiveSparkPlan" else leaf.plan()
            inner = leaf.collectLeaves()
            leaf = inner.apply(0)
        metric = leaf.metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total
