"""Mixing sources to target weights: repetition rates by source, whole copies plus one Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: No source's target is more than so many times its size.
MOST_REPEATS = 3
#: Sources up to which the rate table (under 200 bytes a row) is sent to every task.
BROADCAST_SOURCES = 20_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, rate) for each source of sizes (source, size).

    The sources share the sum of all sizes by weight. A source whose share is over `most` times its size gets just
    that, and the excess is shared again by weight. With sources in the order of size / weight the ones so limited
    are a prefix, which running sums find at once. Windows here range over one row a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(listed) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("most", F.col("source_size") * most)
    every = Window.partitionBy()
    poorest = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    summed = weighed.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.sum("weight").over(every).alias("weights"),
        F.coalesce(F.sum("most").over(poorest), F.lit(0)).alias("most_before"),
        F.coalesce(F.sum("weight").over(poorest), F.lit(0)).alias("weight_before"),
    )
    limited = F.col("most").cast("double") * (F.col("weights") - F.col("weight_before")) < F.col("weight").cast("double") * (F.col("total") - F.col("most_before"))
    marked = summed.withColumn("limited", limited)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("limited"), F.col("most"))).over(every), F.lit(0))
    weight_left = F.col("weights") - F.coalesce(F.sum(F.when(F.col("limited"), F.col("weight"))).over(every), F.lit(0))
    shared = marked.withColumns({"left": left, "weight_left": weight_left})
    target = F.when(F.col("limited"), F.col("most").cast("double")).otherwise(F.col("left") * F.col("weight") / F.greatest(F.col("weight_left"), F.lit(1)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).otherwise(F.lit(0e0))
    return shared.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw(id_column: Column, text: Column | None = None, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends only on the id (for null ids on the text's crc32, where given) and the seed."""
    other = F.crc32(text.cast("binary")).cast("string") if text is not None else F.lit("null")
    name = F.concat(F.coalesce(id_column.cast("string"), other, F.lit("null")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296e0)


def copies(rate: Column, chance: Column) -> Column:
    """floor(rate) whole copies and one more with the fraction as its probability."""
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _with_rates(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Rows joined to their source's rate. The table is broadcast up to BROADCAST_SOURCES rows; beyond that the join is
    left to adaptive execution, which splits a source that holds a large share of the rows."""
    by_source = by_source.withColumnRenamed("source", "of_source")
    small = by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(by_source) if small else by_source, rows["source"].eqNullSafe(by_source["of_source"])).drop("of_source")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, source, size, source_size, target, taken) for every row of docs.

    size is the number of words of the whole text (null: 0), taken the words that the mix takes of it, repeats
    counted. A null source is a source of its own, the last. Null ids draw by their text; rows that repeat an id draw
    alike. Texts are read once; sizes alone are shuffled, and sums are formed before the shuffle. Empty tables give no
    rows; sources without any words have target 0.
    """
    text = F.col(text_col)
    sizes = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), draw(F.col(id_col), text).alias("chance")))
    joined = _with_rates(sizes, cut(rates(sizes)))
    return joined.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("chance"))).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it; see mixture(). The texts themselves aren't shuffled."""
    text = F.col(text_col)
    by_source = cut(rates(docs.select(F.col(source_col).alias("source"), word_count(text).alias("size"))))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source_col).alias("source"), draw(F.col(id_col), text).alias("chance"))
    many = _with_rates(whole, by_source).withColumn("n", copies(F.col("rate"), F.col("chance")).cast("int")).where("n > 0")
    return many.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
