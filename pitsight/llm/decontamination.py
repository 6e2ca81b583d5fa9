"""Finds benchmark items inside documents: size-partitioned MinHash signatures, then exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import cut, hashes, shingles, words

SHINGLE = 5
CONTAINMENT = 0.8
#: Bytes of benchmark text that one pass over the documents carries; a larger benchmark takes more passes.
BLOCK_BYTES = 16 << 20
CHUNK = 1 << 16
#: Members of a signature beyond those that may be missing; the multiplier of the hash that signatures go by.
SURPLUS, SEED = 4, 0x9E3779B97F4A7C15


def tolerance(n: int, containment: float) -> int:
    """How many of n distinct shingles may be missing at the given containment."""
    return int(np.floor(n * (1 - containment) + 1e-9))


def minhash_signature(items: np.ndarray, size: int) -> np.ndarray:
    """The size shingle hashes that are smallest under one more hash: a bottom-k MinHash, whose memory is that of items."""
    mixed = (items ^ (items >> np.uint64(29))) * np.uint64(SEED)
    return np.sort(items[np.argsort(mixed ^ (mixed >> np.uint64(32)), kind="stable")[:size]])


class Index:
    """Signatures of benchmark items, partitioned by their number of distinct shingles.

    Items of 2^k to 2^(k+1)-1 shingles form a partition with one signature size: SURPLUS more than the largest item of
    the partition may miss, or the whole item if it is smaller. A document that contains the item to the required degree
    then holds at least len(signature) - tolerance > 0 of the signature's shingles, whatever its own length: the search
    loses nothing, and the containment itself is counted only for documents that reach that number.
    """

    def __init__(self, items: list[tuple[object, bytes | None]], n: int, containment: float) -> None:
        self.n, self.containment = n, containment
        self.items = [(item, frozenset(found)) for item, text in items if (found := shingles(words((text or b"").lower()), n))]
        values = [np.unique(np.array(hashes(list(found)), np.uint64)) for _, found in self.items]
        largest: dict[int, int] = {}
        for v in values:
            largest[len(v).bit_length()] = max(len(v), largest.get(len(v).bit_length(), 0))
        signatures = [minhash_signature(v, tolerance(largest[len(v).bit_length()], containment) + SURPLUS) for v in values]
        self.needed = [len(s) - tolerance(len(self.items[i][1]), containment) for i, s in enumerate(signatures)]
        flat = np.concatenate([*signatures, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(signatures)), [len(s) for s in signatures])
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        self.keys, self.start = np.unique(flat, return_index=True)
        self.start = np.append(self.start, len(flat))

    def hits(self, text: bytes | None) -> list[tuple[object, int, int]]:
        """(item, its distinct shingles, those the text holds) for every item that the text contains."""
        if not len(self.keys):
            return []
        found = shingles(words((text or b"").lower()), self.n)
        places = []
        for at in range(0, len(found), CHUNK):
            h = np.array(hashes(found[at : at + CHUNK]), np.uint64)
            near = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            places.append(near[self.keys[near] == h])
        places = np.unique(np.concatenate([*places, np.zeros(0, np.int64)]))
        if not len(places):
            return []
        owners = np.concatenate([self.owner[self.start[p] : self.start[p + 1]] for p in places])
        candidates, counts = np.unique(owners, return_counts=True)
        out, held = [], None
        for i, count in zip(candidates, counts):
            if count >= self.needed[i]:
                held = held if held is not None else set(found)
                item, wanted = self.items[i]
                shared = sum(s in held for s in wanted)
                if len(wanted) - shared <= tolerance(len(wanted), self.containment):
                    out.append((item, len(wanted), shared))
        return out


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, n: int, containment: float, block_bytes: int) -> tuple[int, Iterator[Index]]:
    """The number of blocks and their indexes, each made when its turn comes. Blocks are cut by a hash of the item so that
    each holds about block_bytes of text."""
    rows = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    by = F.pmod(F.xxhash64(F.col("item").cast("string"), "text"), F.lit(max(blocks, 1)))
    made = (Index([(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in rows.where(by == b).distinct().orderBy("item", "text").collect()], n, containment) for b in range(blocks))
    return blocks, made


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = SHINGLE, containment: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, item_col, n_shingles, n_shared, containment) for every row of docs and benchmark item where the row's
    text holds at least the given share of the item's distinct n-word shingles (A-Z lower-cased).

    Every text is read whole, in one pass for each block of benchmark texts and without any shuffle; driver and tasks
    hold one block at a time. A text of fewer than n words is one shingle; items without words match nothing, nor do null
    texts. Items with a null id are left out; ids may be of any type; equal benchmark rows count once, equal rows of docs
    each give their rows. Empty tables give no rows. Where item_col is also id_col or one of the figures' names, the item
    comes as benchmark_<item_col>; a figure that bears the name of id_col is replaced by text_<name>.
    """
    figures = ["n_shingles", "n_shared", "containment"]
    shown = f"benchmark_{item_col}" if item_col in (id_col, *figures) else item_col
    names = [id_col, shown, *(f"text_{f}" if f == id_col else f for f in figures)]
    kinds = [docs.schema[id_col].dataType, benchmark.schema[item_col].dataType, LongType(), LongType(), DoubleType()]
    schema = StructType([StructField(f"c{i}", kind) for i, kind in enumerate(kinds)])
    item_type = to_arrow_type(kinds[1])
    source = docs.select(F.col(f"`{id_col}`").alias("c0"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    named = benchmark.where(F.col(f"`{item_col}`").isNotNull())
    blocks, indexes = _indexes(named, item_col, item_text_col, n, containment, block_bytes)
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, hit) for i, text in enumerate(batch.column(1)) for hit in shared.value.hits(text.as_py())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())),
                        pa.array([hit[0] for _, hit in rows], item_type),
                        pa.array([hit[1] for _, hit in rows], pa.int64()),
                        pa.array([hit[2] for _, hit in rows], pa.int64()),
                        pa.array([hit[2] / hit[1] for _, hit in rows], pa.float64()),
                    ],
                    schema.names,
                )

        found = source.mapInArrow(run, schema)
        if blocks > 1:
            found = cut(found)
            shared.destroy()
        out = out.union(found)
    return out.toDF(*names)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = SHINGLE, containment: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs whose text contains no benchmark item, with all their columns; see contaminated(). Items with a
    null id count here, and rows of docs with null ids or texts are treated like any other."""
    blocks, indexes = _indexes(benchmark, item_col, item_text_col, n, containment, block_bytes)
    for index in indexes:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                texts = texts.cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts
                yield batch.filter(pa.array([not shared.value.hits(text.as_py()) for text in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if blocks > 1:
            docs = cut(docs)
            shared.destroy()
    return docs
