"""Language-model scoring by partial matching: a byte-context trie with escapes and symbol exclusion, and token base scores."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words

#: Bytes of context; seven at most.
ORDER = 5
#: Contexts with a next byte whose costs every task holds, the most frequent ones; the others' costs are looked up by a
#: join, so that no count is lost where more occur.
MAX_NODES = 2_000_000
#: Bytes of the contexts that deal the counts into buckets: a bucket holds all longer contexts that end alike, and the
#: counts of shorter ones are sent to all. Contexts in a bucket, as an aim.
SHORT, BUCKET = 2, 400_000
#: Tokens that make up at least one in so many are looked up in a table sent to every task; it has no more rows than that.
FREQUENT = 500_000
#: Bytes that are scored at a time; bytes whose contexts are summed at a time; tokens, and contexts, that a task counts
#: before it hands them on.
CHUNK, SETTLE, FLUSH, FLUSH_CONTEXTS = 1 << 19, 1 << 21, 400_000, 3_000_000
END = b"\n"
TOKEN_BIT = 1 << 63


def message(tokens: list[bytes]) -> bytes:
    """What the model codes: the words with a space between, and an end."""
    return b" ".join(tokens) + END


def grams(data: bytes) -> Iterator[np.ndarray]:
    """Codes of a message's bytes, in pieces: the ORDER bytes before it (ends before the first) and itself."""
    padded = END * ORDER + data
    for at in range(0, len(data), CHUNK):
        b = np.frombuffer(padded[at : at + CHUNK + ORDER], np.uint8).astype(np.uint64)
        n = len(b) - ORDER
        codes = b[:n]
        for k in range(1, ORDER + 1):
            codes = codes << np.uint64(8) | b[k : k + n]
        yield codes


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with the sums of their counts."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(counts, first)


def narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in four bytes each where they fit."""
    return values.astype(np.int32) if not len(values) or values.max() < 1 << 31 else values


def find(sorted_codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted codes, -1 for those that aren't there."""
    if not len(sorted_codes):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_codes, wanted), len(sorted_codes) - 1)
    return np.where(sorted_codes[at] == wanted, at, -1)


class Slots:
    """Costs of distinct codes in open addressing: most are found at their first slot."""

    def __init__(self, codes: np.ndarray, cost: np.ndarray) -> None:
        self.bits = max(8, int(2 * len(codes)).bit_length())
        size = 1 << self.bits
        self.keys, self.full, self.cost = np.zeros(size, np.uint64), np.zeros(size, bool), np.zeros(size, np.float32)
        slot, left = self._slots(codes), np.arange(len(codes))
        while len(left):
            free = left[~self.full[slot[left]]]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.full[slot[won]], self.keys[slot[won]], self.cost[slot[won]] = True, codes[won], cost[won]
            done = np.zeros(len(codes), bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their costs, 0 for those that aren't there, and which are."""
        slot = self._slots(codes)
        found = (self.keys[slot] == codes) & self.full[slot]
        out = np.where(found, self.cost[slot], np.float32(0)).astype(np.float64)
        left = np.flatnonzero(~found & self.full[slot])
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at = slot[left]
            same, full = (self.keys[at] == codes[left]) & self.full[at], self.full[at]
            out[left[same]], found[left[same]] = self.cost[at[same]], True
            left = left[full & ~same]
        return out, found


@dataclass
class Level:
    """Contexts of one length: their next bytes, sums, and what is left of the next shorter one's sums without the
    bytes that they have seen themselves."""

    codes: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    left_total: np.ndarray | None = None
    left_distinct: np.ndarray | None = None


class Trie:
    """Counts of byte contexts and the probabilities that partial matching (method D, full exclusion) gives.

    A byte that followed its context of ORDER bytes in training is coded there, half a count less than it was seen; the
    halves of all different bytes seen are the escape's, which is coded else, and the context loses its first byte. Bytes that the longer context knows are
    excluded from the shorter one's counts. A context never seen costs nothing. Below the empty context all bytes that
    aren't excluded are alike. As counts of shorter contexts are sums over longer ones, what is excluded is just what
    the next longer context has seen: all denominators are known before any text is scored.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, shorter: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """codes: as of grams(); counts: how often each occurred. shorter: where these are only the contexts of some
        buckets, the codes and counts of all contexts of SHORT bytes, ascending."""
        self.levels: list[Level] = []
        codes, counts = summed(codes.astype(np.uint64), counts.astype(np.int64))
        top = codes
        for k in range(ORDER, -1, -1):
            if k == SHORT and shorter is not None:
                codes, counts = shorter[0].astype(np.uint64), shorter[1]
            contexts = codes >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(codes) else np.zeros(0, np.int64)
            total = np.add.reduceat(counts, first) if len(codes) else counts
            self.levels.append(Level(codes, counts, contexts[first], total, np.diff(np.r_[first, len(codes)])))
            codes, counts = summed(codes & np.uint64((1 << 8 * k) - 1), counts)
        for k, (upper, lower) in enumerate(zip(self.levels, self.levels[1:])):
            length = ORDER - k
            known = lower.counts[find(lower.codes, upper.codes & np.uint64((1 << 8 * length) - 1))]
            starts = np.cumsum(np.r_[0, upper.distinct])[:-1].astype(np.int64)
            below = find(lower.contexts, upper.contexts & np.uint64((1 << 8 * (length - 1)) - 1))
            upper.left_total = lower.total[below] - (np.add.reduceat(known, starts) if len(starts) else 0)
            upper.left_distinct = lower.distinct[below] - upper.distinct
        deepest = self.levels[0]
        which = np.repeat(np.arange(len(deepest.total)), deepest.distinct)
        self.seen = Slots(top, np.log10((deepest.counts - 0.5) / deepest.total[which]) if len(top) else np.zeros(0))
        # Only the hash table is asked for these from here on.
        deepest.codes, deepest.counts = deepest.codes[:0].copy(), deepest.counts[:0].copy()
        for level in self.levels:
            for name in ("counts", "total", "distinct", "left_total", "left_distinct"):
                if getattr(level, name) is not None:
                    setattr(level, name, narrow(getattr(level, name)))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of every byte after its context."""
        out, found = self.seen.get(codes)
        rest = np.flatnonzero(~found)
        if len(rest):
            distinct, inverse = np.unique(codes[rest], return_inverse=True)
            out[rest] = self._escaped(distinct)[inverse]
        return out

    def _escaped(self, codes: np.ndarray) -> np.ndarray:
        """The same for bytes that their longest context has never been followed by."""
        cost, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        upper_at = np.full(len(codes), -1)
        for k, level in enumerate(self.levels):
            code = codes & np.uint64((1 << 8 * (ORDER - k + 1)) - 1)
            at, hit = find(level.contexts, code >> np.uint64(8)), find(level.codes, code)
            seen = open_ & (at >= 0)
            total, distinct = (v[at].astype(np.float64) if len(v) else np.zeros(len(codes)) for v in (level.total, level.distinct))
            if k:
                upper, longer = self.levels[k - 1], upper_at >= 0
                if longer.any():
                    total = np.where(longer, upper.left_total[upper_at], total)
                    distinct = np.where(longer, upper.left_distinct[upper_at], distinct)
            coded = seen & (hit >= 0)
            cost[coded] += np.log10((level.counts[hit[coded]] - 0.5) / total[coded])
            open_ &= ~coded
            escape = seen & ~coded & (distinct > 0)
            cost[escape] += np.log10(distinct[escape] / 2 / total[escape])
            upper_at = at
        none = 256 - (int(self.levels[-1].distinct[0]) if len(self.levels[-1].distinct) else 0)
        cost[open_] -= np.log10(none)
        return cost

    def score(self, data: bytes) -> float:
        """log10 of the probability of a whole message."""
        return float(sum(self.log10(codes).sum() for codes in grams(data)))


def packed(rows: DataFrame, parts: int = 64, kind: type = np.int64) -> list[tuple[bytes, bytes]]:
    """(key, n) rows as compressed columns, in parts that tasks make: what the driver gets and passes on takes a few
    bytes a row. Keys ascend within a part. kind: what n is kept as."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        key, n = frame["key"].to_numpy(np.int64), frame["n"].to_numpy(kind)
        return pd.DataFrame({"key": [zlib.compress(np.diff(key, prepend=np.int64(0)).tobytes(), 1)], "n": [zlib.compress(n.tobytes(), 1)]})

    by_part = rows.select("key", "n", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")).groupBy("part")
    return [(bytes(r["key"]), bytes(r["n"])) for r in by_part.applyInPandas(pack, "key binary, n binary").collect()]


def unpacked(parts: list[tuple[bytes, bytes]], kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and their counts."""
    keys = [np.cumsum(np.frombuffer(zlib.decompress(k), np.int64)) for k, _ in parts]
    counts = [np.frombuffer(zlib.decompress(n), kind) for _, n in parts]
    keys, counts = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*counts, np.zeros(0, kind)])
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order]


class Tables:
    """What scoring needs in a task: the frequent contexts' and tokens' costs, made once in each worker."""

    def __init__(self, contexts: list[tuple[bytes, bytes]], frequent: list[tuple[bytes, bytes]]) -> None:
        self.contexts, self.frequent, self._made = contexts, frequent, None

    def made(self) -> tuple[Slots, np.ndarray, np.ndarray]:
        if self._made is None:
            keys, counts = unpacked(self.frequent)
            codes, cost = unpacked(self.contexts, np.float32)
            self._made = Slots(codes.astype(np.uint64), cost), keys, np.log10(counts + 1.0)
        return self._made


class GramCounts:
    """Sums of codes, added in chunks."""

    def __init__(self) -> None:
        self.codes, self.counts, self.waiting, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes)
        self.n += len(codes)
        if self.n >= SETTLE:
            self.settle()

    def settle(self) -> None:
        codes, counts = np.unique(np.concatenate([*self.waiting, np.zeros(0, np.uint64)]), return_counts=True)
        self.codes, self.counts = summed(np.concatenate([self.codes, codes]), np.concatenate([self.counts, counts]))
        self.waiting, self.n = [], 0


def token_keys(tokens: list[bytes]) -> np.ndarray:
    """63-bit hashes of tokens, as negative numbers; codes of byte contexts are positive ones in the same column."""
    digest = xxhash.xxh64_intdigest
    return (np.array([digest(token) for token in tokens], np.uint64) | np.uint64(TOKEN_BIT)).view(np.int64)


def corpus_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n, total): how often each token (negative keys) and each byte after its context (others) occur in all texts,
    and under the key -1 the number of texts, which is that of ends. total: how often the byte's context occurs. Tasks
    sum before the shuffle, which deals out by context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, tokens, n = GramCounts(), Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                found = words((text.as_py() or b"").lower())
                tokens.update(found)
                for codes in grams(message(found)):
                    contexts.add(codes)
                if len(tokens) > FLUSH:
                    yield rows(token_keys(list(tokens)), np.fromiter(tokens.values(), np.int64, len(tokens)))
                    tokens.clear()
                if len(contexts.codes) > FLUSH_CONTEXTS:
                    contexts.settle()
                    yield rows(contexts.codes.astype(np.int64), contexts.counts)
                    contexts = GramCounts()
        contexts.settle()
        yield rows(token_keys(list(tokens)), np.fromiter(tokens.values(), np.int64, len(tokens)))
        yield rows(contexts.codes.astype(np.int64), contexts.counts)
        yield rows(np.array([-1], np.int64), np.array([n], np.int64))

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    parts = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "key long, n long")
    dealt = parts.withColumn("context", F.shiftright("key", 8)).repartition("context")
    summed_up = dealt.groupBy("context", "key").agg(F.sum("n").alias("n"))
    return summed_up.select("key", "n", F.sum("n").over(Window.partitionBy("context")).alias("total"))


@dataclass
class LanguageModel:
    """The tables that tasks score with, and all tokens' and contexts' counts in the shared folder. least: the count
    from which on contexts are in the tables."""

    tables: Tables
    counts: DataFrame
    contexts: DataFrame
    least: int
    n_contexts: int
    train_tokens: int
    vocabulary: int
    ends: int


def least_count(contexts: DataFrame, most: int) -> tuple[int, int]:
    """The least n that no more than `most` rows reach: 1 wherever all rows fit. And the number of all rows."""
    groups = contexts.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("sum")).orderBy(F.desc("n")).collect()
    seen, total, every = 0, 0, sum(row["rows"] for row in groups)
    for row in groups:
        seen, total = seen + row["rows"], total + row["sum"]
        if seen > most:
            # Rows of a count of at least total / most can't be more than most.
            return (row["n"] + 1 if row["n"] < 10_000 else -(-total // most)), every
    return 1, every


def seen_cost() -> Column:
    """Of a byte that its whole context was followed by in training."""
    return F.log10((F.col("n") - F.lit(0.5)) / F.col("total"))


def fit(docs: DataFrame, text_col: str = "text", max_nodes: int = MAX_NODES) -> LanguageModel:
    """Counts all rows of docs. What reaches the driver is bounded by max_nodes and FREQUENT, whatever the corpus; all
    counts stay in the shared folder, and scoring takes from there what the tables don't hold."""
    counts = cut(corpus_counts(docs, text_col))
    tokens, contexts = counts.where("key < -1").drop("total"), counts.where("key >= 0")
    ends = counts.where("key = -1").first()
    ends = ends["n"] if ends else 0
    n, v = tokens.agg(F.sum("n"), F.count(F.lit(1))).first()
    n, v = (n or 0) + ends, v + (ends > 0)
    least, n_contexts = least_count(contexts, max_nodes)
    kept = contexts.where(F.col("n") >= least).select("key", seen_cost().alias("n"))
    often = tokens.where(F.col("n") * FREQUENT >= n)
    return LanguageModel(Tables(packed(kept, kind=np.float32), packed(often)), tokens, contexts, least, n_contexts, n, v, ends)


def escaped(model: LanguageModel, wanted: DataFrame) -> DataFrame:
    """(key, cost) of codes that training doesn't have: they are coded by escapes to shorter contexts.

    The counts of contexts longer than SHORT bytes are those of codes that end alike, so a bucket of such codes is the
    whole trie for what falls into it; the shorter contexts' counts are at most 2**24 numbers and sent to all.
    """
    spread = max(64, -(-(model.n_contexts + wanted.count()) // BUCKET))
    mask = (1 << 8 * (SHORT + 1)) - 1
    shorter = packed(model.contexts.groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.sum("n").alias("n")))
    shared = wanted.sparkSession.sparkContext.broadcast(shorter)

    def cost(frame: pd.DataFrame) -> pd.DataFrame:
        asked = frame["n"].to_numpy(np.int64) == 0
        keys = frame["key"].to_numpy(np.int64)
        if not asked.any():
            return pd.DataFrame({"key": np.zeros(0, np.int64), "cost": np.zeros(0)})
        codes = keys.astype(np.uint64)
        trie = Trie(codes[~asked], frame["n"].to_numpy(np.int64)[~asked], unpacked(shared.value))
        return pd.DataFrame({"key": keys[asked], "cost": trie.log10(codes[asked])})

    # The byte itself isn't part of the context.
    ending = F.shiftright("key", 8).bitwiseAND(F.lit(mask))
    both = model.contexts.select("key", "n").union(wanted.select("key", F.lit(0).cast("long").alias("n")))
    by_bucket = both.withColumn("bucket", F.pmod(F.xxhash64(ending), F.lit(spread))).groupBy("bucket")
    return by_bucket.applyInPandas(cost, "key long, cost double")


#: What a row's value is: a token's or a context's frequency in the document, or the document's own sums.
TOKEN, GRAM, N_TOKENS, KNOWN, BASE, SCORE = range(6)


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score) for every row, over its whole text.

    Null and empty texts consist of an end only. Equal rows give equal results, one each. Texts are read once and not
    shuffled: frequent contexts and tokens are scored in place; of the others only code or hash, document and frequency
    are sent to where their counts lie, and what is rare can't be a hot key. Contexts that the tables lack and training
    has never seen get their cost by escapes, once for each (escaped()).
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model.tables)
    end_cost, end_known = float(np.log10(model.ends + 1.0)), int(model.ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, frequent, costs = shared.value.made()
        for batch in batches:
            texts = batch.column(1)
            at, done = 0, batch.num_rows
            while at < done:
                first, size = at, 0
                found, digests, pieces, of, sums = [], [], [], [], []
                while at < done and size < CHUNK:
                    raw = texts[at].as_py() or b""
                    found.append(words(raw.lower()))
                    digests.append(xxhash.xxh64_intdigest(raw))
                    data = message(found[-1])
                    sums.append(0.0)
                    for codes in grams(data):
                        if len(data) > CHUNK:
                            # Of a long text's pieces only what the tables lack is kept.
                            each, there = slots.get(codes)
                            sums[-1] += float(each.sum())
                            codes = codes[~there]
                        pieces.append(codes)
                        of.append(at - first)
                    size += len(data)
                    at += 1
                yield part(batch.column(0).slice(first, at - first), found, digests, pieces, of, sums, slots, frequent, costs)

    def part(ids, found, digests, pieces, piece_of, sums, slots, frequent, costs) -> pa.RecordBatch:
        n = len(found)
        scores = np.array(sums)
        gram_doc, grams_, gram_tf = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0)]
        if pieces:
            codes = np.concatenate(pieces)
            of = np.repeat(piece_of, [len(p) for p in pieces])
            each, there = slots.get(codes)
            scores = scores + np.bincount(of, each, n)
            missed = np.flatnonzero(~there)
            # A document's repeats of a code go as one row.
            order = missed[np.lexsort((codes[missed], of[missed]))]
            if len(order):
                c, d = codes[order], of[order]
                start = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
                gram_doc.append(d[start])
                grams_.append(c[start])
                gram_tf.append(np.diff(np.r_[start, len(order)]).astype(np.float64))
        gram_doc, gram_keys, gram_tf = np.concatenate(gram_doc), np.concatenate(grams_).astype(np.int64), np.concatenate(gram_tf)
        counted = [Counter(tokens) for tokens in found]
        doc = np.repeat(np.arange(n), [len(c) for c in counted])
        keys = token_keys([token for c in counted for token in c])
        tf = np.array([k for c in counted for k in c.values()], np.float64)
        place = find(frequent, keys)
        often = place >= 0
        base = np.bincount(doc[often], tf[often] * costs[place[often]], n) + end_cost if n else np.zeros(0)
        known = np.bincount(doc[often], tf[often], n) + end_known
        tokens = np.array([len(t) + 1 for t in found], np.float64)
        digest = np.array(digests, np.uint64).view(np.int64)
        rare = np.flatnonzero(~often)
        own = np.arange(n)
        of = np.concatenate([doc[rare], gram_doc, own, own, own, own])
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(of)),
                pa.array(digest[of]),
                # A document's own rows go anywhere: their keys match no token and no context, which has 48 bits.
                pa.array(np.concatenate([keys[rare], gram_keys, *[(digest + k) & np.int64(2**63 - 1) | np.int64(2**62) for k in range(4)]])),
                pa.array(np.concatenate([np.full(len(rare), TOKEN), np.full(len(gram_keys), GRAM), *[np.full(n, k) for k in (N_TOKENS, KNOWN, BASE, SCORE)]]).astype(np.int32)),
                pa.array(np.concatenate([tf[rare], gram_tf, tokens, known, base, scores])),
            ],
            ["id", "digest", "key", "what", "value"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = cut(source.mapInArrow(run, f"id {kind}, digest long, key long, what int, value double"))
    asked = rows.where(F.col("what") == GRAM).select("key").distinct()
    # Codes that were seen as often as the tables' are all in the tables.
    below = model.contexts.where(F.col("n") < model.least)
    unseen = cut(asked.join(below, "key", "left_anti"))
    no_count, no_cost = F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("cost")
    known = model.counts.select("key", "n", no_cost).union(below.select("key", no_count, seen_cost().alias("cost"))).union(escaped(model, unseen).select("key", no_count, "cost"))
    joined = rows.join(known, "key", "left")

    def total(what: int, value: Column | None = None) -> Column:
        return F.sum(F.when(F.col("what") == what, F.col("value") if value is None else value).otherwise(0e0))

    by_doc = joined.groupBy("id", "digest").agg(
        F.sum((F.col("what") == N_TOKENS).cast("long")).alias("copies"),
        total(N_TOKENS).alias("n_tokens"),
        (total(KNOWN) + total(TOKEN, F.when(F.col("n").isNotNull(), F.col("value")).otherwise(0e0))).alias("n_known"),
        (total(BASE) + total(TOKEN, F.col("value") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1e0)))).alias("base"),
        (total(SCORE) + total(GRAM, F.col("value") * F.col("cost"))).alias("score"),
    )
    each = by_doc.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    scale = float(np.log10(model.train_tokens + model.vocabulary + 1.0))
    copies = F.col("copies")
    return each.select(
        F.col("id").alias(id_col),
        (F.col("n_tokens") / copies).cast("long").alias("n_tokens"),
        (F.col("n_known") / copies).cast("long").alias("n_known"),
        ((F.col("base") - F.col("n_tokens") * scale) / copies).alias("base_score"),
        (F.col("score") / copies).alias("score"),
    )
