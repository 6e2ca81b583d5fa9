"""Pieces that several corpus operators share: words, shingles, tables, cut points in a lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maximal runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name that may hold dots or backticks."""
    return f"`{name.replace('`', '``')}`"


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text. bytes.split() without arguments splits at exactly those six characters."""
    return text.split() if text else []


def shingles(tokens: list[bytes], n: int) -> list[bytes]:
    """Every run of n words, space-joined and with repeats; a shorter sequence is one shingle, none gives none."""
    if len(tokens) <= n:
        return [b" ".join(tokens)] if tokens else []
    joined, ends, at = b" ".join(tokens), [], -1
    for token in tokens:
        at += len(token) + 1
        ends.append(at)
    starts = [0, *(end + 1 for end in ends)]
    return [joined[a:b] for a, b in zip(starts, ends[n - 1 :])]


def hashes(items: list[bytes], seed: int = 42) -> list[int]:
    digest = xxhash.xxh64_intdigest
    return [digest(item, seed) for item in items]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with one more column; a column of that name is replaced."""
    columns = {field: batch.column(i) for i, field in enumerate(batch.schema.names) if field != name}
    return pa.RecordBatch.from_pydict(columns | {name: values})


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir; where none is named
    and all runs on this machine (tests), a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise RuntimeError("name a shared folder in spark.checkpoint.dir")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "pitsight-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back, so that a lost executor costs no more than the stage at
    hand and nothing above is computed twice."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As cut(), as a table of Parquet files: for loops, since a checkpoint keeps the size estimates of its whole plan,
    which grow with every join that a round adds, and files have their true sizes."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that are run within hand Python so many rows at a time: for rows that hold long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
