"""Hard negatives: each shard keeps a vector-approximation file, bounds by table lookup rule rows out, exact scores decide."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V

SCALE, CELLS = 256, 256
#: Positives of an anchor, negatives of a positive, and the window of their scores in percent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Pairs scored exactly at a time.
PAIRS = 1 << 16
NONE = -V.LONG_MAX - 1


@dataclass(frozen=True)
class Approximation:
    """Vectors by the cell of each dimension: codes (rows x dimensions), and each cell's smallest and largest component."""

    codes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    reach: int

    @classmethod
    def of(cls, rows: np.ndarray, cells: int = CELLS) -> Approximation:
        """Cells that hold about equally many of the rows; their bounds are components that rows have."""
        n, d = rows.shape
        codes, low, high = np.zeros((n, d), np.uint8), np.zeros((d, cells), rows.dtype), np.zeros((d, cells), rows.dtype)
        for j in range(d):
            values = np.sort(rows[:, j])
            cuts = np.unique(values[np.arange(1, cells) * n // cells])
            codes[:, j] = np.searchsorted(cuts, rows[:, j], side="right")
            starts = np.r_[0, np.searchsorted(values, cuts, side="left")]
            ends = np.r_[starts[1:], n]
            used = np.flatnonzero(ends > starts)
            low[j, used], high[j, used] = values[starts[used]], values[ends[used] - 1]
        return cls(codes, low, high, V.largest(rows))

    def bounds(self, asked: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray] | None:
        """Least and greatest inner product that each row of the part (first axis) can have with each question: for every
        dimension a table of cells by questions, looked up with the rows' codes and summed. None where sums could leave
        a long."""
        most = asked.shape[1] * self.reach * V.largest(asked)
        if most >= V.LONG_MAX:
            return None
        kind = np.int32 if most < 1 << 31 else np.int64
        shape = (len(self.codes[part]), len(asked))
        least, greatest = np.zeros(shape, kind), np.zeros(shape, kind)
        for j in range(asked.shape[1]):
            one, other = self.low[j][:, None] * asked[None, :, j], self.high[j][:, None] * asked[None, :, j]
            code = self.codes[part, j]
            least += np.minimum(one, other).astype(kind)[code]
            greatest += np.maximum(one, other).astype(kind)[code]
        return least, greatest


def scored(asked: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs (q, r)."""
    most = asked.shape[1] * V.largest(asked) * V.largest(rows)
    out = np.zeros(len(q), np.int64)
    for a in range(0, len(q), PAIRS):
        x, y = asked[q[a : a + PAIRS]], rows[r[a : a + PAIRS]]
        if most < V.LONG_MAX:
            out[a : a + PAIRS] = np.einsum("ij,ij->i", x, y)
        else:
            out[a : a + PAIRS] = np.clip((x.astype(object) * y.astype(object)).sum(axis=1), -V.LONG_MAX, V.LONG_MAX)
    return out


def window_top(asked: np.ndarray, own: np.ndarray, who: np.ndarray, low: np.ndarray, high: np.ndarray, file: Approximation, rows: np.ndarray, places: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, row, score): window i takes the k highest exact scores with vector who[i] of the asked, from low to high
    (equal scores by smaller id), its own place left out. In a tile, the k-th greatest lower bound among rows that lie in
    the window for certain is a score that k rows reach; rows whose upper bound is under that, or whose bounds miss the
    window, are never scored."""
    q = r = score = np.zeros(0, np.int64)
    floor = low.copy()
    for b in range(0, len(rows), V.TILE_ROWS):
        part = slice(b, b + V.TILE_ROWS)
        allowed = places[part, None] != own[None, who]
        found = file.bounds(asked, part)
        if found is None:
            may = allowed
        else:
            least, greatest = found[0][:, who], found[1][:, who]
            certain = np.where(allowed & (least >= low) & (greatest <= high), least.astype(np.int64), NONE)
            if len(certain) > k:
                floor = np.maximum(floor, np.partition(certain, -k, axis=0)[-k])
            may = allowed & (greatest >= floor) & (least <= high)
        more_r, more_q = np.nonzero(may)
        exact = scored(asked, rows, who[more_q], more_r + b)
        inside = (exact >= low[more_q]) & (exact <= high[more_q])
        q, r, score = np.r_[q, more_q[inside]], np.r_[r, more_r[inside] + b], np.r_[score, exact[inside]]
        kept = V.top(q, score, ids[r], k)
        q, r, score = q[kept], r[kept], score[kept]
        # A window with a full list needs at least the score of its last row.
        full = np.bincount(q, minlength=len(who)) == k
        worst = np.full(len(who), V.LONG_MAX)
        np.minimum.at(worst, q, score)
        floor = np.where(full, np.maximum(floor, worst), floor)
    return q, r, score


POSITIVE_LISTS = "place long, anchor_id long, shard int, id long, score long"
NEGATIVE_LISTS = "place long, anchor_id long, number int, positive_id long, positive_score long, shard int, id long, score long"


def mine(
    vectors: DataFrame, label: Column, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", shard_bytes: int = V.SHARD_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a condition on the
    column id) and each of its best other rows of the same label, the highest-scoring rows of other labels whose score
    lies from low to high percent of the positive's. Scores are inner products of floor(scale * x) components, equal ones
    by smaller id (null last).

    Rows with a null label, a null vector or null or non-finite components take no part, nor do pairs of vectors of
    different lengths. An anchor's own row is no positive; rows that repeat an id are rows of their own. Positives with a
    negative score have an empty window. Anchors without positives, and tables without other labels, give no row. Both
    steps pass each shard's rows by all anchors in batches; lists of shards are merged up a tree."""
    rows = V.quantised(vectors.where(label.isNotNull()), scale, id_col, vector_col, label)
    shards = V.shard_count(rows, shard_bytes)
    anchors = rows.where(is_anchor)
    near = V.merged(V.over_shards(rows, anchors, shards, _begin, _positives(positives), POSITIVE_LISTS), ["place", "anchor_id"], shards, positives)
    lists = near.groupBy("place").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("positives"))
    asked = anchors.join(lists, "place")
    empty = F.array().cast("array<struct<number:int,positive_id:bigint,positive_score:bigint>>")
    far = V.over_shards(rows.withColumn("positives", empty), asked, shards, _begin, _negatives(negatives, low, high), NEGATIVE_LISTS)
    found = V.merged(far, ["place", "anchor_id", "number", "positive_id", "positive_score"], shards, negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _begin(pieces: list[pa.RecordBatch]) -> dict:
    """The shard: places, ids and their nulls, and by length the rows' positions, labels, components and approximation."""
    ids = V.column(pieces, "id")
    labels = V.column(pieces, "label").to_numpy()
    found = {}
    for length, (at, rows) in (V.by_length(V.column(pieces, "comps")) if pieces else {}).items():
        order = np.argsort(labels[at], kind="stable")
        at, rows = at[order], rows[order]
        found[length] = at, labels[at], rows, Approximation.of(rows)
    nulls = ids.is_null().to_numpy(zero_copy_only=False)
    return {"place": V.column(pieces, "place").to_numpy(), "id": ids.fill_null(V.LONG_MAX).to_numpy(), "null": nulls, "by_length": found}


def _tiles(shard: dict, asked: pa.RecordBatch) -> Iterator[tuple]:
    """(label, positions among the asked, their components, the shard's rows of that length and label range)."""
    labels = V.column([asked], "label").to_numpy()
    for length, (which, questions) in V.by_length(V.column([asked], "comps")).items():
        if length not in shard["by_length"]:
            continue
        for label in np.unique(labels[which]):
            same = np.flatnonzero(labels[which] == label)
            for a in range(0, len(same), V.TILE_ASKED):
                some = same[a : a + V.TILE_ASKED]
                yield label, which[some], questions[some], shard["by_length"][length]


def _picked(file: Approximation, keep: slice | np.ndarray) -> Approximation:
    return Approximation(file.codes[keep], file.low, file.high, file.reach)


def _positives(k: int):
    def answer(shard: dict, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        number = asked.column(asked.schema.get_field_index("shard"))[0].as_py()
        places, ids = (V.column([asked], c).to_numpy() for c in ("place", "id"))
        for label, which, questions, (at, labels, rows, file) in _tiles(shard, asked):
            same = slice(np.searchsorted(labels, label), np.searchsorted(labels, label, side="right"))
            mine, every = at[same], np.full(len(which), V.LONG_MAX)
            q, r, score = window_top(questions, places[which], np.arange(len(which)), -every, every, _picked(file, same), rows[same], shard["place"][mine], shard["id"][mine], k)
            picked = mine[r]
            yield pa.RecordBatch.from_arrays(
                [pa.array(places[which][q]), pa.array(ids[which][q]), pa.array(np.full(len(q), number, np.int32)), pa.array(shard["id"][picked], mask=shard["null"][picked]), pa.array(score)],
                ["place", "anchor_id", "shard", "id", "score"],
            )

    return answer


def _negatives(k: int, low: int, high: int):
    def answer(shard: dict, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        number = asked.column(asked.schema.get_field_index("shard"))[0].as_py()
        places, ids = (V.column([asked], c).to_numpy() for c in ("place", "id"))
        lists = V.column([asked], "positives").to_pylist()
        for label, which, questions, (at, labels, rows, file) in _tiles(shard, asked):
            # Rows of other labels lie before and after those of this one.
            others = (slice(0, np.searchsorted(labels, label)), slice(np.searchsorted(labels, label, side="right"), len(at)))
            # A window for each positive that can have one.
            windows = [(i, p) for i, w in enumerate(which) for p in lists[w] if p["positive_score"] >= 0]
            who = np.array([i for i, _ in windows], np.int64)
            least = np.array([-(-low * p["positive_score"] // 100) for _, p in windows], np.int64)
            most = np.array([high * p["positive_score"] // 100 for _, p in windows], np.int64)
            for other in others:
                theirs = at[other]
                q, r, score = window_top(questions, places[which], who, least, most, _picked(file, other), rows[other], shard["place"][theirs], shard["id"][theirs], k)
                picked, chosen = theirs[r], [windows[i][1] for i in q]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(places[which][who[q]]), pa.array(ids[which][who[q]]), pa.array([p["number"] for p in chosen], pa.int32()), pa.array([p["positive_id"] for p in chosen], pa.int64()),
                        pa.array([p["positive_score"] for p in chosen], pa.int64()), pa.array(np.full(len(q), number, np.int32)), pa.array(shard["id"][picked], mask=shard["null"][picked]), pa.array(score),
                    ],
                    ["place", "anchor_id", "number", "positive_id", "positive_score", "shard", "id", "score"],
                )

    return answer
