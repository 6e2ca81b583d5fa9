"""SimHash near-duplicate groups through a segment-popcount embedding, and near copies by MinHash bands and exact shingle
similarity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut, hashes, shingles, words, written
from .components import connected_components

#: The embedding: 32 segments of two bits, each with a bit count of 0, 1 or 2.
EVEN_BITS = 0x5555555555555555
#: Segments in each of the five groups that the grid's coordinates come from.
GROUPS = (7, 7, 6, 6, 6)
#: Points of a grid cell up to which all its pairs are looked at.
CELL_PAIRS = 48
#: Near copies: bands of a text's MinHash values and values in each (a pair at 0.8 shares no band in 0.03 % of cases); longs
#: of its parity sketch; members of a cell that a task compares with as many others at a time.
BANDS, BAND_ROWS, SKETCH, NEAR_CELL = 20, 5, 16, 256
#: Candidates of a point that are looked at first where there are very many; rows of two texts that a task holds at a time;
#: texts up to which those to compare are named to every task, so that others aren't shuffled.
BEST, PAIR_ROWS, NAMED = 3, 256, 1 << 21
CHUNK = 1 << 16
#: The MinHash functions: h -> (h ^ MIX[0]) * MIX[1], of which the smallest counts.
MIX = np.random.default_rng(1).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def bit_counts(text: bytes | None, n: int = 3) -> tuple[np.ndarray, int]:
    """In how many of the shingles' XXH64 values each bit is set, and the number of shingles."""
    items = shingles(words(text.lower()) if text else [], n)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(items), CHUNK):
        h = np.array(hashes(items[at : at + CHUNK]), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones, len(items)


def packed_bits(bits: np.ndarray) -> int:
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def simhash(text: bytes | None, n: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half the XXH64 values of the shingles."""
    ones, total = bit_counts(text, n)
    return packed_bits(ones * 2 > total)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text, A-Z lower-cased. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(text.as_py(), n) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"id {kind}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def thermometer(fp: Column) -> Column:
    """The segments' bit counts, each in unary (0 = 00, 1 = 01, 2 = 11) in its own two bits: the Manhattan distance of
    two embeddings is then the number of bits in which their thermometers differ."""
    even, shifted = F.lit(EVEN_BITS), F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(shifted).bitwiseAND(even)
    full = fp.bitwiseAND(shifted).bitwiseAND(even)
    return some.bitwiseOR(F.shiftleft(full, 1))


def _grids() -> list[int]:
    """The projected grids: coordinates in three of the five groups. A Manhattan distance of two or less leaves at
    least three groups without any difference, so such points share a cell in one grid at least."""
    masks, at = [], 0
    for size in GROUPS:
        masks.append(((1 << 2 * size) - 1) << at)
        at += 2 * size
    return [_signed(a | b | c) for a, b, c in combinations(masks, 3)]


def similar_fingerprints(distinct_fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly those fingerprints that differ in two bits or fewer, directly or over a chain.

    Points that share a grid cell are compared: first the Manhattan distance of the embeddings, a lower bound of the
    Hamming distance, then the Hamming distance itself. Cells with more than CELL_PAIRS points (large groups of near
    copies) are not expanded into pairs: two fingerprints differ in at most two bits exactly if some value is within
    one bit of both, so every member names its 65 such values and is linked to the smallest that names the same.
    Edges are thus at most CELL_PAIRS * 10 / 2 or 65 a fingerprint, however large a group grows.
    """
    points = distinct_fps.select("fp", thermometer(F.col("fp")).alias("t"))
    cells = points.select(
        "fp",
        "t",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(g).alias("g"), F.col("t").bitwiseAND(F.lit(mask)).alias("cell"))
                    for g, mask in enumerate(_grids())
                )
            )
        ).alias("at"),
    ).select("fp", "t", "at.g", "at.cell")
    shared = cells.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = cut(cells.join(shared, ["g", "cell"]))
    few = crowded.where(F.col("n") <= CELL_PAIRS).drop("n")
    other = few.select("g", "cell", F.col("fp").alias("fp2"), F.col("t").alias("t2"))
    pairs = (
        few.join(other, ["g", "cell"])
        .where(F.col("fp") < F.col("fp2"))
        .where(F.bit_count(F.col("t").bitwiseXOR(F.col("t2"))) <= 2)
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= 2)
        .select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    )
    many = crowded.where(F.col("n") > CELL_PAIRS).select("fp").distinct()
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << bit))) for bit in range(64)))
    named = many.select("fp", F.explode(near).alias("point"))
    least = named.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = named.join(least, "point").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.union(stars)


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id_col, fp, component_id) for every row: component_id is the smallest id of the rows that can be reached over
    fingerprints that differ in two bits or fewer.

    Nulls: a null text counts as empty; a null id is never a component's name (a component of null ids only has a
    null component_id). Equal rows give equal results, one each. An empty table gives an empty result. Other columns
    are ignored. Texts are read once; everything later handles 16 bytes a row. Rows with the same fingerprint are one
    point, so exact copies cost nothing beyond the first.
    """
    rows = cut(fingerprints(docs, id_col, text_col, n))
    points = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    labels = connected_components(similar_fingerprints(points.select("fp")))
    linked = labels.join(points, labels["node"] == points["fp"]).select("fp", "root", "first")
    named = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    renamed = linked.select("fp", "root").join(named, "root").select("fp", "lowest")
    of = points.join(renamed, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"))
    # As an expression the key isn't taken for the one that the points were grouped by: both sides are shuffled for this
    # join alone, and adaptive execution can split a fingerprint that very many rows have.
    named = of.select(F.col("fp").bitwiseXOR(F.lit(0).cast("long")).alias("fp"), "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def minhash_bands(h: np.ndarray) -> list[int]:
    """Signed hashes of the bands of a set of shingle hashes, each with its number; all empty sets have the same."""
    least = np.full(MIX.shape[1], np.iinfo(np.uint64).max)
    for at in range(0, len(h), 1 << 10):
        least = np.minimum(least, ((h[at : at + (1 << 10), None] ^ MIX[0]) * MIX[1]).min(0))
    return [_signed(xxhash.xxh64_intdigest(band.tobytes(), k)) for k, band in enumerate(least.reshape(BANDS, BAND_ROWS))]


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in 64 * SKETCH bins. An element of only one of two sets changes one parity, so the
    sketches of two sets differ in no more bits than there are such elements."""
    return np.packbits(np.bincount(h % np.uint64(64 * SKETCH), minlength=64 * SKETCH) & 1, bitorder="little").view(np.int64)


def profiles(docs: DataFrame, text_col: str = "text", n: int = 5) -> DataFrame:
    """(key, size, bands, s0, s1 ...) for every row: digest of its text, number of its distinct n-word shingles, hashes of
    its MinHash bands, parity sketch."""
    names = ["key", "size", "bands", *(f"s{k}" for k in range(SKETCH))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bands, sketches = [], [], []
            for text in batch.column(1):
                h = np.array(hashes(list(shingle_set(text.as_py(), n))), np.uint64)
                sizes.append(len(h))
                bands.append(minhash_bands(h))
                sketches.append(parity_sketch(h))
            columns = np.array(sketches, np.int64).reshape(-1, SKETCH).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), *map(pa.array, columns)], names)

    text = F.col(f"`{text_col}`")
    source = docs.select(text_key(text).alias("key"), text.cast("binary").alias("text"))
    return source.mapInArrow(run, "key string, size long, bands array<long>, " + ", ".join(f"{c} long" for c in names[3:]))


def text_key(text: Column) -> Column:
    """Digest that stands for a text; null and empty texts have the same."""
    return F.md5(F.coalesce(text.cast("binary"), F.lit(b"")))


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in docs.columns))


def _of(points: DataFrame, side: str) -> DataFrame:
    """Points with their figures, all names ending with the side."""
    return points.select(F.col("point").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ["size", *(f"s{k}" for k in range(SKETCH))]))


def sketch_distance(a: str = "a", b: str = "b") -> Column:
    """In how many bits two sketches differ: a lower bound of the number of shingles that only one text has."""
    return sum((F.bit_count(F.col(f"s{k}_{a}").bitwiseXOR(F.col(f"s{k}_{b}"))) for k in range(1, SKETCH)), F.bit_count(F.col(f"s0_{a}").bitwiseXOR(F.col(f"s0_{b}"))))


def may_be_similar(similarity: float, a: str = "a", b: str = "b") -> Column:
    """False only for pairs under the similarity: sets of x and y shingles with d in one of them alone have the similarity
    (x + y - d) / (x + y + d), and d is no less than the sketches' distance or the difference of x and y."""
    x, y = F.col(f"size_{a}"), F.col(f"size_{b}")
    return F.greatest(sketch_distance(a, b), F.abs(x - y)) * (1 + similarity) <= (1 - similarity) * (x + y) + 1e-6


def band_cells(points: DataFrame) -> DataFrame:
    """(cell, point, n, leader) for the points (point, bands) of every band that several have in common: their number, and
    the one that meets most others in all its cells, which in a group of copies of one text is mostly that text."""
    cells = points.select("point", F.explode("bands").alias("cell"))
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(cells.join(shared, "cell"))
    weights = met.groupBy("point").agg(F.sum("n").alias("weight"))
    leaders = met.join(weights, "point").groupBy("cell").agg(F.max(F.struct("weight", "point"))["point"].alias("leader"))
    return written(met.join(leaders, "cell"))


def open_pairs(cells: DataFrame, roots: DataFrame, points: DataFrame, similarity: float) -> DataFrame:
    """(a, b, d), a < b, for all pairs of a cell without its leader that lie in two components (node, root) and that their
    sketches don't exclude; d is the sketches' distance.

    Cells within one component are left out. Members are dealt into blocks of about NEAR_CELL, every two of which meet in
    one group of the join: a crowded cell takes many groups, none of which is large, and only pairs that may be similar
    become rows.
    """
    members = cells.where("n > 2 AND point != leader").join(roots, cells["point"] == roots["node"], "left")
    members = members.select("cell", "point", F.coalesce("root", "point").alias("root"))
    mixed = members.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    blocks = F.ceil(F.col("n") / NEAR_CELL)
    dealt = members.join(mixed.select("cell", blocks.alias("blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("point"), "blocks"))
    dealt = written(dealt)

    def side(name: str, own: str, other: str, others: Column) -> DataFrame:
        rows = dealt.select("cell", F.col("point").alias(name), F.col("root").alias(f"root_{name}"), F.col("block").alias(own), F.explode(others).alias(other))
        return rows.join(_of(points, name), name)

    left = side("a", "i", "j", F.sequence("block", F.col("blocks") - 1))
    right = side("b", "j", "i", F.sequence(F.lit(0).cast("long"), "block"))
    right = right.withColumnsRenamed({c: f"{c}_right" for c in ("cell", "i", "j")})
    on = [left[c] == right[f"{c}_right"] for c in ("cell", "i", "j")]
    once = (F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))
    found = left.join(right, [*on, once & (F.col("root_a") != F.col("root_b")) & may_be_similar(similarity)])
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), sketch_distance().alias("d")).distinct()


def shingle_set(text: bytes | None, n: int) -> frozenset[bytes]:
    return frozenset(shingles(words((text or b"").lower()), n))


def similar_pairs(pairs: DataFrame, points: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) of points whose texts share at least the given part of all their distinct n-word shingles.

    texts: (key, text) of every row. Only texts that some pair names are shuffled, if those are NAMED or fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, frozenset()
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != last:
                    last, held = a, shingle_set(batch.column(2)[i].as_py(), n)
                other = shingle_set(batch.column(3)[i].as_py(), n)
                both = len(held & other)
                good.append(both >= similarity * (len(held) + len(other) - both) - 1e-9)
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    named = written(pairs.select(F.explode(F.array("a", "b")).alias("point")).distinct().join(points.select("point", "key"), "point"))
    if named.count() <= NAMED:
        some = F.broadcast(named.select(F.xxhash64("key").alias("_h")).distinct())
        texts = texts.join(some, F.xxhash64("key") == F.col("_h"), "left_semi")
    needed = written(texts.join(named, "key").dropDuplicates(["point"]).select("point", "text"))
    left, right = (needed.select(F.col("point").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def joined_components(pairs: DataFrame, roots: DataFrame, points: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """The components (node, root) that roots become with the similar ones of the pairs (a, b, d).

    All pairs are compared by their words at once if they are no more than the points. Else the BEST nearest of each point
    are; then components are renewed, and of the pairs that still lie in two of them the nearest of each point and of each
    two components are compared, twice as many as before, and so on until none is left. Every pair is compared or lies
    within one component, so that a large group of near copies costs some comparisons a point, not all its pairs."""
    spark, left, most, first = points.sparkSession, written(pairs), BEST, True
    bound = points.count()
    while rows := left.count():
        taken = left
        if rows > bound:
            near = Window.partitionBy("b").orderBy("d", "a")
            taken = taken.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= most).drop("_r")
            if not first:
                between = Window.partitionBy(F.least("root_a", "root_b"), F.greatest("root_a", "root_b")).orderBy("d", "a", "b")
                # The first window leaves few rows of a point, the second few of two components.
                taken = taken.withColumn("_r", F.row_number().over(between)).where(F.col("_r") <= most).drop("_r")
        taken = written(taken.select("a", "b"))
        with arrow_rows(spark, PAIR_ROWS):
            added = written(similar_pairs(taken, points, texts, n, similarity))
        if not added.isEmpty():
            roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(added))
        if rows <= bound:
            break
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        rest = left.select("a", "b", "d").join(taken, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        rest = rest.withColumns({"root_a": F.coalesce("root_a", "a"), "root_b": F.coalesce("root_b", "b")})
        left, most, first = written(rest.where(F.col("root_a") != F.col("root_b"))), most * 2, False
    return roots


def near_copies(docs: DataFrame, text_col: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, root): the component of every distinct text (text_key()), links being pairs of texts whose sets of n-word
    shingles have at least the given Jaccard similarity.

    MinHash bands find the pairs, the words decide: no pair below the similarity is linked; of those at 0.8 one in 3,000
    shares no band, of others fewer. Equal texts are one point. First all points of a cell are compared with its leader;
    then all other pairs of cells that still lie in two components, see open_pairs(). Every pair that shares a cell is thus
    compared, excluded by an exact bound, or within one component, however large a group is and however many points
    there are.
    """
    points = written(profiles(docs, text_col, n).dropDuplicates(["key"]).withColumn("point", F.monotonically_increasing_id()))
    text = F.col(f"`{text_col}`")
    texts = docs.select(text_key(text).alias("key"), text.cast("binary").alias("text"))
    cells = band_cells(points)
    led = cells.where("point != leader").select(F.least("point", "leader").alias("a"), F.greatest("point", "leader").alias("b")).distinct()
    first = written(led.join(_of(points, "a"), "a").join(_of(points, "b"), "b").where(may_be_similar(similarity)).select("a", "b"))
    with arrow_rows(docs.sparkSession, PAIR_ROWS):
        links = written(similar_pairs(first, points, texts, n, similarity))
    roots = connected_components(links)
    pairs = open_pairs(cells, roots, points, similarity).join(first, ["a", "b"], "left_anti")
    labels = joined_components(pairs, roots, points, texts, n, similarity)
    return points.join(labels, points["point"] == labels["node"], "left").select("key", F.coalesce("root", "point").alias("root"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near copies: of the rows whose texts are linked (near_copies()), one stays, that with
    the smallest id; null ids come last, ties are decided by digests of text and row.

    Rows are told apart by all their columns, not by id: different texts under one id are different documents. Null and
    empty texts are copies of each other. Of rows equal in all columns one stays. An empty table gives no rows. Texts
    are shuffled only where the rows to remove don't fit a broadcast that Spark has sized.
    """
    rooted = near_copies(docs, text_col, n, similarity)
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    listed = docs.select(text_key(text).alias("key"), row_hash(docs).alias("row"), id_.alias("id"))
    each = cut(listed.groupBy("key", "row").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).join(rooted, "key"))
    stays = each.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "row")).alias("first"))
    judged = each.join(stays, "root").withColumn("kept", (F.col("key") == F.col("first.key")) & (F.col("row") == F.col("first.row")))
    gone = judged.where(~F.col("kept")).select(F.col("key").alias("__key"), F.col("row").alias("__row"))
    repeated = cut(judged.where(F.col("kept") & (F.col("n") > 1)).select(F.col("key").alias("__key"), F.col("row").alias("__row")))
    on = (F.col("__key") == text_key(text)) & (F.col("__row") == row_hash(docs))
    kept = docs.join(gone, on, "left_anti")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, on, "left_anti").union(docs.join(repeated, on, "left_semi").dropDuplicates())
