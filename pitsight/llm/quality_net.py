"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_column, words

#: Rows of the vector table: words go to the first part by hash, word shapes to the rest.
WORD_ROWS, SHAPE_ROWS = 1 << 15, 1 << 10
WIDTH = 64
WINDOW = 2
#: Labelled documents that the model is fitted on at most, the lowest by hash of their id.
FIT_ROWS = 12_000
#: Fitted documents whose rows only set the temperature: one in so many.
CALIBRATION = 8
#: Features of a document, see pooled().
FEATURES = 2 * WIDTH + 4
BLOCK = 1 << 9
CHUNK = 1 << 15
CACHE = 1 << 18
SEED = 20_240_601
#: Row that stands between texts.
GAP = WORD_ROWS + SHAPE_ROWS


def index_vectors() -> np.ndarray:
    """Sparse ternary index vectors: four +1 and four -1 in each row, the same on every machine."""
    rng = np.random.default_rng(SEED)
    places = rng.random((WORD_ROWS + SHAPE_ROWS, WIDTH), dtype=np.float32).argpartition(8, axis=1)[:, :8]
    out = np.zeros((WORD_ROWS + SHAPE_ROWS, WIDTH), np.float32)
    np.put_along_axis(out, places[:, :4], 1, axis=1)
    np.put_along_axis(out, places[:, 4:], -1, axis=1)
    return out


def shape_of(word: bytes) -> bytes:
    """Coarse outline of a word: first and last character class, case, a length class, and the last two characters
    where they are neither letters nor digits."""
    tail = word[-2:] if not word[-1:].isalnum() and word[-1] < 128 else b""
    case = b"U" if word.isupper() else b"T" if word[:1].isupper() else b"l"
    return b"%b|%d|%b|%d" % (case, min(len(word).bit_length(), 5), tail, word[:1].isalnum() or word[0] > 127)


class Rows:
    """Table rows of words, remembered for the words met so far."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, tokens: list[bytes]) -> np.ndarray:
        """Word rows in the first row of the result, shape rows in the second."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        packed = [known.get(token, -1) for token in tokens]
        for i, row in enumerate(packed):
            if row < 0:
                token = tokens[i]
                row = zlib.crc32(token) % WORD_ROWS << 16 | zlib.crc32(shape_of(token)) % SHAPE_ROWS
                packed[i] = known[token] = row
        both = np.array(packed, np.int64)
        return np.stack([both >> 16, (both & 0xFFFF) + WORD_ROWS])


def add_contexts(total: np.ndarray, rows: np.ndarray, index: np.ndarray) -> None:
    """Adds to each word's (and shape's) context vector the index vectors of its neighbours within WINDOW. A row GAP
    stands between texts; it has no index vector, and what it is given is left out."""
    x = index[rows[0]] + index[rows[1]]
    around = np.zeros_like(x)
    for d in range(1, WINDOW + 1):
        around[d:] += x[:-d] if len(x) > d else 0
        around[:-d] += x[d:] if len(x) > d else 0
    for own in rows:
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
        total[own[order][first]] += np.add.reduceat(around[order], first, axis=0)


def context_vectors(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of context vectors over all rows of texts, each scaled to length one.

    Tasks add up whole documents into a table of fixed size and hand it on in compressed blocks of BLOCK rows, which are
    summed by block: what moves depends on the number of tasks and the table, and the table alone reaches the driver. Sums are of
    whole numbers and exact, so that their order doesn't matter.
    """
    size = WORD_ROWS + SHAPE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows = np.vstack([index_vectors(), np.zeros((1, WIDTH), np.float32)]), Rows()
        total, some = np.zeros((size + 1, WIDTH), np.float64), False
        gap, waiting, n = np.full((2, WINDOW), GAP), [], 0
        for batch in batches:
            for text in batch.column(0):
                tokens = words(text.as_py())
                for at in range(0, len(tokens), CHUNK):
                    waiting += [rows.of(tokens[at : at + CHUNK]), gap]
                    n, some = n + waiting[-2].shape[1], True
                    if n >= CHUNK:
                        add_contexts(total, np.concatenate(waiting, axis=1), index)
                        waiting, n = [], 0
        if n:
            add_contexts(total, np.concatenate(waiting, axis=1), index)
        if some:
            blocks, whole = range(0, size, BLOCK), total.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(blocks), pa.int32()), pa.array([zlib.compress(whole[b : b + BLOCK].tobytes(), 1) for b in blocks], pa.binary())],
                ["block", "data"],
            )

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(data), np.int64) for data in parts["data"])
        return pd.DataFrame({"block": parts["block"][:1], "data": [total.tobytes()]})

    parts = texts.select(F.col(text_col).cast("binary")).mapInArrow(run, "block int, data binary")
    table = np.zeros((size, WIDTH), np.float64)
    for row in parts.groupBy("block").applyInPandas(add, "block int, data binary").collect():
        table[row["block"] : row["block"] + BLOCK] = np.frombuffer(row["data"], np.int64).reshape(-1, WIDTH)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def pooled(tokens: list[bytes], vectors: np.ndarray, index: np.ndarray, rows: Rows) -> np.ndarray:
    """A document's features: mean context vector of its words and of their shapes, how far the mean index vector is
    from what distinct words would give, the share of neighbours with the same index vector, and the logarithm of its
    length. No words: zeros."""
    n, last, same = len(tokens), -1, 0
    word, shape, raw = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH)
    for at in range(0, n, CHUNK):
        of = rows.of(tokens[at : at + CHUNK])
        same += int((of[0][1:] == of[0][:-1]).sum()) + int(of[0][0] == last)
        last = of[0][-1]
        word += vectors[of[0]].sum(0)
        shape += vectors[of[1]].sum(0)
        raw += index[of[0]].sum(0)
    if not n:
        return np.zeros(FEATURES, np.float32)
    crowding = float(raw @ raw) / n / 8
    return np.concatenate([word / n, shape / n, [math.log(crowding / n + 1e-6), math.log1p(crowding), same / n, math.log1p(n)]]).astype(np.float32)


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = (np.asarray(p, np.float64) for p in self.layers)
        return np.tanh(np.clip((x.astype(np.float64) - self.centre) / self.scale, -6, 6) @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """To nine digits, so that a row's doesn't depend on the rows that it is computed with."""
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35))), 9)


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, decay: float = 3e-3, least_steps: int = 1_000) -> tuple:
    """Weights of a tanh layer and a logistic one, by Adam on the cross entropy, from a fixed seed. Few rows are gone
    through more often, so that least_steps are taken."""
    epochs = max(epochs, -(-least_steps // -(-len(x) // 256)))
    rng = np.random.default_rng(SEED)
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for at in range(0, len(x), 256):
            part = order[at : at + 256]
            a, step = x[part], step + 1
            h = np.tanh(a @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -35, 35)))
            d = (p - y[part]) / len(part)
            dh = np.outer(d, w[2]) * (1 - h * h)
            for i, g in enumerate((a.T @ dh + decay * w[0], dh.sum(0), h.T @ d + decay * w[2], d.sum(keepdims=True))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w[0].astype(np.float32), w[1].astype(np.float32), w[2].astype(np.float32), float(w[3][0])


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the lowest cross entropy on held-back rows, over a fixed grid; 1 without such rows."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(0, math.log(16), 121))
    loss = [np.mean(np.logaddexp(0, -np.where(y > 0, 1, -1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fits vectors on all documents, network and temperature on labelled ones.

    Context vectors are sums over every text of docs and need no labels. Of the ids with a label that isn't null, the fit_rows lowest by hash are used (an id with several labels counts
    with the highest; of several texts with one id, the lowest in byte order is used). Everything that reaches the
    driver is bounded by fit_rows and the size of the vector table. Without any labelled document every text scores
    one half; with labels of one class the scores tend to that class.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    some = named.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    # At most fit_rows rows of an id and an int.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    sample = cut(texts.join(F.broadcast(some), "id").groupBy("id", "y").agg(F.min("text").alias("text")))
    vectors = context_vectors(texts)
    shared = sample.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows = index_vectors(), Rows()
        for batch in batches:
            found = [pooled(words(text.as_py()), shared.value, index, rows).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["y", "x", "part"])

    part = (F.crc32(F.col("id").cast("string").cast("binary")) / 7).cast("long") % CALIBRATION
    got = sample.select("y", "text", part.cast("int").alias("part")).mapInArrow(run, "y int, x binary, part int").toPandas()
    shared.unpersist()
    return fit_features(vectors, got)


def fit_features(vectors: np.ndarray, got: pd.DataFrame) -> QualityModel:
    width = FEATURES
    # In a fixed order, so that reruns agree.
    got = got.sort_values(["part", "y", "x"]).reset_index(drop=True)
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, width)
    y, held = got["y"].to_numpy(np.float64), (got["part"] == 0).to_numpy()
    if not len(y):
        zero = (np.zeros((width, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), 0.0)
        return QualityModel(vectors, np.zeros(width, np.float32), np.ones(width, np.float32), zero, 1.0)
    if held.all():
        held = ~held
    centre, scale = x[~held].mean(0), x[~held].std(0) + 1e-3
    layers = train_network(np.clip((x[~held] - centre) / scale, -6, 6), y[~held])
    model = QualityModel(vectors, centre, scale, layers, 1.0)
    model.temperature = best_temperature(model.logits(x[held]), y[held])
    return model


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score", threshold: float | None = None) -> DataFrame:
    """docs with a column score (double, 0 to 1); with a threshold, only the rows that reach it.

    Every row is scored over its whole text; null and empty texts have no words and get the score of that. A column
    of docs named like score_col is replaced; other columns pass through untouched.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows = index_vectors(), Rows()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            texts = texts.cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts
            x = np.array([pooled(words(text.as_py()), shared.value.vectors, index, rows) for text in texts], np.float32).reshape(-1, FEATURES)
            p = shared.value.probabilities(x).astype(np.float64)
            out = with_column(batch, score_col, pa.array(p, pa.float64()))
            yield out if threshold is None else out.filter(pa.array(p >= threshold))

    fields = [f for f in docs.schema.fields if f.name != score_col]
    docs = docs.select(*(F.col(f"`{f.name}`") for f in fields))
    schema = type(docs.schema)([*fields]).add(score_col, "double")
    return docs.mapInArrow(run, schema)


def training_fold(id_col: Column, folds: int = 3, held: int = 1) -> Column:
    """False for held-out ids, those whose crc32 as text leaves the remainder held; ids that are null aren't held out."""
    remainder = F.crc32(id_col.cast("string").cast("binary")) % folds
    return F.coalesce(remainder != held, F.lit(True))
