"""Ranked lexical search: term-bucketed postings, item terms joined to them, whole-number scores, top lists by window."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, quoted, shared_folder

#: Buckets that terms are dealt to by their hash; a search reads no row group without one of its buckets.
BUCKETS = 1024
#: Bytes of weighted item terms up to which every task gets them all, and slices of a term's postings beyond that.
BROADCAST_BYTES, SLICES = 32 << 20, 64
#: Postings of a batch that goes to the JVM.
BATCH = 1 << 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything in ASCII but letters and digits parts terms; only A-Z have a lower case.
_TO_TERMS = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, repeats included: bytes of longer sequences are all 128 or more, so that a table of 256
    bytes and a split at blanks find the maximal matches of the pattern."""
    return text.translate(_TO_TERMS).split(b" ") if text else []


def term_column(text: Column) -> Column:
    """The same in the JVM, for the few texts that are asked with."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM_PATTERN), F.lit(0))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(place, doc_id, term, tf, n): one row for each document and distinct term, and one without a term for each
    document that has any, whose tf is 1; n is the number of the document's terms.

    A row of docs is a document, told apart by its place in the table, so that repeated ids and repeated rows stay
    documents of their own. Null and empty texts have no row. Other columns of any name are passed over. A task holds
    one batch of texts and the postings of one document."""
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField("place", T.LongType()), T.StructField("doc_id", id_type), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("n", T.LongType())]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33
        rows: tuple[list, ...] = ([], [], [], [], [])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                place += 1
                found = Counter(terms(text.as_py()))
                del found[b""]
                n = found.total()
                if not n:
                    continue
                size = len(found) + 1
                for column, values in zip(rows, ([place] * size, [doc_id] * size, [None, *found], [1, *found.values()], [n] * size)):
                    column.extend(values)
                if len(rows[0]) >= BATCH:
                    yield as_batch(rows, batch.schema.field(0).type)
                    rows = ([], [], [], [], [])
        if rows[0]:
            yield as_batch(rows, batch.schema.field(0).type)

    def as_batch(rows: tuple[list, ...], doc_type: pa.DataType) -> pa.RecordBatch:
        kinds = (pa.int64(), doc_type, pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(values, kind) for values, kind in zip(rows, kinds)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    return docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(listed, T.StructType(fields))


def write_index(docs: DataFrame, path: str, only: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the postings of docs as a table ordered by bucket and term within each file, and returns it. Where only
    (term) is given, other terms have no postings; documents without any of them are still counted. A document's
    postings stay in the task that read it: nothing is shuffled for the index, and its sums are added up there."""
    rows = postings(docs, id_col, text_col)
    if only is not None:
        # Rows without a term count documents and stay; their keys equal no term and differ, so that no task gets them all.
        wanted = only.select(F.col("term").alias("_t")).distinct()
        key = F.coalesce("term", F.concat(F.lit("\x00"), F.col("place").cast("string")))
        rows = rows.join(_sized(wanted), key == F.col("_t"), "left").where(F.col("term").isNull() | F.col("_t").isNotNull()).drop("_t")
    rows.withColumn("bucket", bucket_of(F.col("term"))).sortWithinPartitions("bucket", "term").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item. Rows of one id are one item, a null id is one of its own; items
    without terms give no row."""
    return items.select(F.col(quoted(item_col)).alias("item_id"), F.explode(term_column(F.col(quoted(text_col)))).alias("term")).distinct()


def ranked(index: DataFrame, asked: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents of the index, scores above 0, equal ones by
    ascending doc_id (null last); repeated ids stand as often as they are in the table.

    asked: (item_id, term). Sizes and document frequencies are one aggregation each, with partial sums in every task.
    Item terms go to all tasks where they are at most BROADCAST_BYTES, so that a document's points are summed where its
    postings lie; beyond that the join shuffles both sides by term and slice, so that no common term is one task's. A
    top list is cut in every task before its rows meet."""
    sizes = index.where(F.col("term").isNull()).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_terms")).first()
    # Without documents nothing is divided.
    n_docs, n_terms = sizes["n_docs"], sizes["n_terms"] or 1
    met = index.where(F.col("term").isNotNull())
    frequency = met.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    share = F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    weighted = asked.join(frequency, "term").select("item_id", "term", bucket_of(F.col("term")).alias("bucket"), F.floor(1000 * F.log(share)).cast("long").alias("w"))
    weighted = cut(weighted.where("w > 0"))
    length = f"(100 - 50 + (50 * n * {n_docs}L) div {n_terms}L)"
    points = F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 20 * {length}))")
    matches = _joined(met, weighted)
    scores = matches.groupBy("item_id", "place", "doc_id").agg(F.sum(points).alias("score")).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "place")
    top = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Ranks all docs for each item, see `ranked`. The index holds the items' terms only; it is a table in the shared
    folder, so texts are read once and a lost executor costs the rows at hand. Without documents or items, or where no
    term is shared, the result is empty."""
    asked = item_terms(items, item_col, item_text_col)
    index = write_index(docs, f"{shared_folder(docs.sparkSession)}/lexical-{uuid.uuid4().hex}", asked.select("term"), id_col, text_col)
    return ranked(index, asked, k)


def _sized(rows: DataFrame) -> DataFrame:
    """Terms marked for broadcast where all their bytes are within the bound."""
    size = rows.agg(F.sum(F.octet_length(rows.columns[0]) + 32)).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def _joined(met: DataFrame, weighted: DataFrame) -> DataFrame:
    size = weighted.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return met.join(F.broadcast(weighted), ["bucket", "term"])
    sliced = weighted.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return met.withColumn("slice", F.pmod(F.xxhash64("place"), F.lit(SLICES)).cast("int")).join(sliced, ["bucket", "term", "slice"])
