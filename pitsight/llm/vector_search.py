"""Exact top-k search by inner product: tiles of questions times tiles of rows, a selection in each, lists merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V

SCALE = 1024
LISTS = "place long, query_id long, shard int, id long, score long"


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", shard_bytes: int = V.SHARD_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector that is_query holds for (a condition on the column id), the k
    others with the highest inner products of floor(scale * x) components, ties to the smaller id (null last).

    Vectors null or with null or non-finite components take no part; vectors of different lengths have no product.
    A query's own row is left out, another row that repeats its id isn't; every query row has its own list. Scores
    beyond a long are its ends. Tables without queries or other rows give no row. Queries meet the shards of all rows in
    batches; a tile holds TILE_ASKED x TILE_ROWS products."""
    rows = V.quantised(vectors, scale, id_col, vector_col)
    shards = V.shard_count(rows, shard_bytes)
    lists = V.over_shards(rows, rows.where(is_query), shards, _begin, _answering(k), LISTS)
    found = V.merged(lists, ["place", "query_id"], shards, k)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _begin(pieces: list[pa.RecordBatch]) -> dict:
    """The shard: places, ids and their nulls, and the matrices by length."""
    ids = V.column(pieces, "id")
    nulls = ids.is_null().to_numpy(zero_copy_only=False)
    return {"place": V.column(pieces, "place").to_numpy(), "id": ids.fill_null(V.LONG_MAX).to_numpy(), "null": nulls, "by_length": V.by_length(V.column(pieces, "comps")) if pieces else {}}


def _answering(k: int):
    def answer(shard: dict, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        number = asked.column(asked.schema.get_field_index("shard"))[0].as_py()
        places, ids = (V.column([asked], c).to_numpy() for c in ("place", "id"))
        for length, (which, questions) in V.by_length(V.column([asked], "comps")).items():
            if length not in shard["by_length"]:
                continue
            at, rows = shard["by_length"][length]
            for a in range(0, len(which), V.TILE_ASKED):
                mine = which[a : a + V.TILE_ASKED]
                q, r, score = _best(questions[a : a + V.TILE_ASKED], places[mine], rows, shard["place"][at], shard["id"][at], k)
                picked = at[r]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places[mine][q]), pa.array(ids[mine][q]), pa.array(np.full(len(q), number, np.int32)), pa.array(shard["id"][picked], mask=shard["null"][picked]), pa.array(score)],
                    ["place", "query_id", "shard", "id", "score"],
                )

    return answer


def _best(questions: np.ndarray, own: np.ndarray, rows: np.ndarray, places: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, score) of each question's k best rows, its own left out: tile by tile, what reaches the k-th score
    of a tile joins the list of the tiles before it."""
    q = r = np.zeros(0, np.int64)
    score = np.zeros(0, np.int64)
    for b in range(0, len(rows), V.TILE_ROWS):
        tile = V.products(questions, rows[b : b + V.TILE_ROWS])
        allowed = own[:, None] != places[None, b : b + V.TILE_ROWS]
        tile = np.where(allowed, tile, -V.LONG_MAX - 1)
        reach = np.partition(tile, -k, axis=1)[:, -k] if tile.shape[1] > k else np.full(len(tile), -V.LONG_MAX - 1)
        more_q, more_r = np.nonzero(allowed & (tile >= reach[:, None]))
        q, r, score = np.r_[q, more_q], np.r_[r, more_r + b], np.r_[score, tile[more_q, more_r]]
        kept = V.top(q, score, ids[r], k)
        q, r, score = q[kept], r[kept], score[kept]
    return q, r, score
