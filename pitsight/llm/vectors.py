"""What searches over vectors share: whole-number components, rows dealt to shards of bounded size, questions that pass
every shard, exact products of tiles, top lists and their merging as a tree."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, shared_folder

#: Bytes of components that a task holds as one shard; rows and questions of a tile; lists merged into one a round.
SHARD_BYTES, TILE_ROWS, TILE_ASKED, FAN_IN = 32 << 20, 8192, 128, 16
LONG_MAX = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(place, id, label, comps): each vector's components as floor(scale * x), x as double, in a table of the shared
    folder. Null vectors and those that hold null, NaN or infinite components have no row. Place tells rows apart, also
    those that repeat an id; it is written once, so that later reads agree on it. Components beyond the range of a long
    are taken as its ends."""
    x = F.col(quoted(vector_col))
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.monotonically_increasing_id().alias("place"), F.col(quoted(id_col)).cast("long").alias("id"), (F.lit(None) if label is None else label).cast("long").alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("comps"),
    )
    path = f"{shared_folder(vectors.sparkSession)}/vectors-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return vectors.sparkSession.read.parquet(path)


def shard_count(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards that hold at most shard_bytes of components each, about, eight bytes a component; smaller ones, down to a
    sixteenth, where cores would have nothing to do."""
    size = rows.agg(F.sum(F.size("comps") * 8 + 16)).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // shard_bytes), min(cores, -(-size * 16 // shard_bytes)))


def own_shard(shards: int) -> Column:
    """The shard of a row, from its place, so that no id, label or equal vectors make a shard larger than others."""
    return F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int")


def over_shards(rows: DataFrame, asked: DataFrame, shards: int, begin: Callable, answer: Callable, schema: str) -> DataFrame:
    """Each shard's rows, then every row of asked, one shard after the other in a task: begin(pieces) makes what answer
    needs from the shard's rows, answer(state, piece) gives record batches for a batch of questions. rows and asked have
    the same columns, with a place; asked is repeated for each shard, rows are shuffled once. A task holds one shard and
    a batch of questions, however many there are."""
    mine = rows.withColumns({"shard": own_shard(shards), "kind": F.lit(0)})
    theirs = asked.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "kind": F.lit(1)})
    dealt = mine.unionByName(theirs).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, state = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, kind = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("shard", "kind"))
            starts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(starts, [*starts[1:], len(shard)]):
                piece = batch.slice(a, b - a)
                if shard[a] != now:
                    now, pieces, state = shard[a], [], None
                if kind[a] == 0:
                    pieces.append(piece)
                    continue
                if state is None:
                    state, pieces = begin(pieces), []
                yield from answer(state, piece)

    return dealt.mapInArrow(run, schema)


def column(pieces: list[pa.RecordBatch], name: str) -> pa.Array:
    found = [p.column(p.schema.get_field_index(name)) for p in pieces]
    return pa.concat_arrays(found) if found else pa.array([], pa.int64())


def by_length(comps: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and whole-number matrix of the vectors of each length: only vectors of one length have a product."""
    if not len(comps):
        return {}
    lengths = pc.list_value_length(comps).to_numpy()
    found = {}
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        found[int(d)] = at, comps.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)
    return found


def largest(matrix: np.ndarray) -> int:
    return max(abs(int(matrix.max())), abs(int(matrix.min()))) if matrix.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices: as doubles where no sum can leave their exact
    range, as longs where none can leave that, else as unbounded numbers; beyond a long its ends."""
    most = a.shape[1] * largest(a) * largest(b)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < LONG_MAX:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -LONG_MAX, LONG_MAX).astype(np.int64)


def top(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each group's k highest scores, equal ones by smaller id, best first."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    first = np.r_[True, sorted_group[1:] != sorted_group[:-1]] if len(order) else np.zeros(0, bool)
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(first, at, 0)) < k]


def merged(lists: DataFrame, keys: list[str], shards: int, k: int, fan_in: int = FAN_IN) -> DataFrame:
    """The k best rows of each key by (score, id), with their rank: lists of fan_in shards are merged into one a round,
    up a tree, so that no task gets more than fan_in lists of a key, however many shards there are."""
    best = [F.desc("score"), F.col("id").asc_nulls_last()]
    while shards > fan_in:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("int"))
        near = Window.partitionBy(*keys, "shard").orderBy(*best)
        lists = lists.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k).drop("_r")
        shards = -(-shards // fan_in)
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
