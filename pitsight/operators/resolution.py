"""Teams resolved in the order in which they arrive, where an earlier row decides what a later one means."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

RESOLVED = "seq long, provider string, provider_id string, canonical_id string, method string, confidence double, status string, detail string"
#: What each method says in a diagnostic.
DETAILS = {
    "provider_id": "provider id has a canonical id", "historical_alias": "franchise alias has a canonical id", "alias": "alias of a known name", "normalized_name": "name has one canonical id", "exact_id": "new canonical id",
    "ambiguous": "name has several canonical ids",
}


def components(edges: DataFrame) -> DataFrame:
    """(node, label): nodes of the edges (a, b), with one label for all that are connected, their smallest.

    Each round takes the smallest label around a node and then that label's own label, so that rounds grow with the
    logarithm of the longest path; equi-joins and minima only. Every round is written to the shared folder."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        closer = labels.join(around, labels["node"] == around["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        jump = closer.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        moved = written(closer.join(jump, closer["label"] == jump["_n"]).select("node", F.least("label", "_l").alias("label"), "before"))
        changed = moved.where(F.col("label") != F.col("before")).isEmpty()
        labels = moved.select("node", "label")
        if changed:
            return labels


def _keys() -> Column:
    """What a row can share with another, hashed: equal hashes of different keys only make a component larger."""
    key = lambda kind, *parts: F.xxhash64(F.lit(kind), *parts)
    return F.array(key("p", "provider", "provider_id"), key("n", "name_key"), F.when(F.col("franchise").isNotNull(), key("f", "franchise")), key("f", "own_franchise"))


def resolved_in_order(rows: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(seq, provider, provider_id, canonical_id, method, confidence, status, detail): each row resolved by what the rows
    before it in seq have bound: its provider id; else the franchise that an alias gives it; else its name; else it is
    new and binds its own id. A name and a franchise keep the first id that they get; a name that the catalog has several
    ids for is ambiguous and quarantines what only it could resolve.

    rows: (seq, provider, provider_id, own_id, name_key, aliased, franchise, own_franchise), franchise may be null.
    ambiguous: (name_key). Rows that share no key, directly or over others, can't affect each other: components of the
    key graph are folded side by side, each in the order of seq, in a pass over sorted batches. A task holds the keys of
    one component, not its rows; a component of very many rows is one task's, as its order is what decides."""
    listed = rows.join(ambiguous.select("name_key").distinct().withColumn("several", F.lit(True)), "name_key", "left").withColumn("_k", F.array_compact(_keys()))
    edges = listed.select(F.element_at("_k", 1).alias("a"), F.explode("_k").alias("b")).distinct()
    labelled = components(edges)
    placed = listed.withColumn("_node", F.element_at("_k", 1)).join(labelled, F.col("_node") == F.col("node")).select("label", "seq", "provider", "provider_id", "own_id", "name_key", "aliased", "franchise", "own_franchise", F.coalesce("several", F.lit(False)).alias("several"))
    tasks = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return placed.repartition(int(tasks), "label").sortWithinPartitions("label", "seq").mapInPandas(_fold, RESOLVED)


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, state = None, Bindings()
    for frame in frames:
        out = []
        for label, seq, provider, provider_id, own_id, name, aliased, franchise, own_franchise, several in frame.itertuples(index=False, name=None):
            if label != now:
                now, state = label, Bindings()
            found, method, confidence = state.resolve((provider, provider_id), own_id, name, bool(aliased), franchise, own_franchise, bool(several))
            out.append((seq, provider, provider_id, found, method, confidence, "quarantined" if found is None else "resolved", DETAILS[method]))
        yield pd.DataFrame(out, columns=["seq", "provider", "provider_id", "canonical_id", "method", "confidence", "status", "detail"])


class Bindings:
    """What the rows so far have bound."""

    def __init__(self):
        self.providers: dict[tuple, str] = {}
        self.names: dict[str, str] = {}
        self.franchises: dict[str, str] = {}

    def resolve(self, provider: tuple, own_id: str, name: str, aliased: bool, franchise: str | None, own_franchise: str | None, several: bool) -> tuple[str | None, str, float | None]:
        if provider in self.providers:
            found = self.providers[provider]
            self.names.setdefault(name, found)
            return found, "provider_id", 1.0
        if franchise is not None and franchise in self.franchises:
            return self._bind(provider, self.franchises[franchise], name, None), "historical_alias", 1.0
        if several:
            return None, "ambiguous", None
        if name in self.names:
            method, confidence = ("alias", 1.0) if aliased else ("normalized_name", 0.95)
            return self._bind(provider, self.names[name], name, own_franchise), method, confidence
        return self._bind(provider, own_id, name, own_franchise), "exact_id", 1.0

    def _bind(self, provider: tuple, found: str, name: str, franchise: str | None) -> str:
        self.providers[provider] = found
        self.names.setdefault(name, found)
        if franchise is not None:
            self.franchises.setdefault(franchise, found)
        return found


def diagnostics(resolved: DataFrame) -> DataFrame:
    """The last diagnostic of each provider id, status and detail: what a replay would report once."""
    last = F.max_by(F.struct("seq", "canonical_id", "method", "confidence"), "seq")
    return resolved.groupBy("provider", "provider_id", "status", "detail").agg(F.count(F.lit(1)).alias("n"), last.alias("d")).select("provider", "provider_id", "status", "detail", "n", "d.seq", "d.canonical_id", "d.method", "d.confidence")
