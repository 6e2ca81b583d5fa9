"""Removal of repeated runs of lines: winnowing over line hashes, joined positions, matches extended both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

#: Words from which a repeated run is removed; any longer run of whole lines is found for certain.
RUN_WORDS = 50
NO_ID = -(1 << 63)
DOC = ["id", "digest"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, pos, n, hash, words, start) for every line with a word: its place among all lines and among those
    with words, the hash of its trimmed text, its number of words, and the words before it."""
    text = F.col(text_col)
    every = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("digest"), F.posexplode(_lines(text)).alias("pos", "line"))
    worded = every.select("id", "digest", "pos", F.xxhash64(F.btrim("line", F.lit(" \t\n\v\f\r"))).alias("hash"), F.regexp_count("line", F.lit(WORD_PATTERN)).cast("long").alias("words")).where("words > 0")
    # Rows that repeat id and text are one document.
    once = worded.repartition(*DOC).dropDuplicates([*DOC, "pos"])
    before = Window.partitionBy(*DOC).orderBy("pos")
    return once.select(
        *DOC,
        "pos",
        F.row_number().over(before).alias("n"),
        "hash",
        "words",
        F.coalesce(F.sum("words").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )


def winnowed(lines: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(gram, id, digest, n): the fingerprints of every document.

    A gram is the shortest run of lines from a line on with half of run_words words, hashed in order. In every window
    of grams that start within half of run_words words, the smallest hash (of equal ones the last) is selected. A run
    of whole lines with run_words words or more holds all grams of one window, so it holds a selected one, and the
    same one wherever the run occurs.
    """
    half = run_words // 2
    by_start = Window.partitionBy(*DOC).orderBy("start")
    span = by_start.rangeBetween(0, half - 1)
    grams = lines.select(
        *DOC,
        "n",
        "start",
        F.when(F.sum("words").over(span) >= half, F.xxhash64(F.collect_list("hash").over(span))).alias("gram"),
    ).where(F.col("gram").isNotNull())
    least = F.min(F.struct("gram", (-F.col("n")).alias("back"))).over(by_start.rangeBetween(0, half))
    return grams.select(*DOC, least.alias("least")).select("least.gram", *DOC, (-F.col("least.back")).alias("n")).distinct()


def anchors(fingerprints: DataFrame) -> DataFrame:
    """(id, digest, n) of the positions whose fingerprint stands at another position too, one row each."""
    repeated = fingerprints.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("gram")
    return fingerprints.join(repeated, "gram", "left_semi").select(*DOC, "n").distinct()


def runs_at(lines: DataFrame, anchored: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(run, id, digest, n, from_pos, to_pos): every shortest run of run_words words that begins, or that ends, with some
    line and holds an anchor, as a hash. These are an anchor's matches moved out by one line at a time to either side."""
    of = lines.join(anchored.withColumn("anchor", F.lit(True)), [*DOC, "n"], "left")
    ahead = Window.partitionBy(*DOC).orderBy("start").rangeBetween(0, run_words - 1)
    back = Window.partitionBy(*DOC).orderBy("end").rangeBetween(1 - run_words, 0)

    def run(side: int, span: Window) -> Column:
        return F.when(
            (F.sum("words").over(span) >= run_words) & F.max("anchor").over(span),
            F.struct(F.xxhash64(F.lit(side), F.collect_list("hash").over(span)).alias("run"), F.min("pos").over(span).alias("from_pos"), F.max("pos").over(span).alias("to_pos")),
        )

    both = of.withColumn("end", F.col("start") + F.col("words")).select(*DOC, "n", F.array_compact(F.array(run(0, ahead), run(1, back))).alias("runs"))
    return both.select(F.explode("runs").alias("r"), *DOC, "n").select("r.run", *DOC, "n", "r.from_pos", "r.to_pos")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """(id, digest, from_pos, to_pos): the lines of every document that lie in a run of whole lines with at least
    run_words words that also stands earlier: in a document with a smaller id (of equal ids, a smaller text hash; null
    ids come first) or further up in the same document. Runs that meet or overlap are one.

    Positions of winnowed fingerprints are joined, and matches extended from there to both sides, a line at a time: a
    step holds if the run of run_words words that ends with the new line (or begins with it) stands earlier as well, and
    the extension ends at the first that doesn't. As every line of a long repeated run lies in such a run of its own, the
    steps are compared with the first place of each alone, whichever documents share more or less: there are never more
    rows than twice the lines near anchors, however often a passage occurs or however it is shuffled.
    """
    lines = cut(line_table(docs, id_col, text_col))
    anchored = cut(anchors(winnowed(lines, run_words)))
    near = lines.join(anchored.select(*DOC).distinct(), DOC, "left_semi")
    runs = cut(runs_at(near, anchored, run_words))
    first = runs.groupBy("run").agg(F.min(F.struct(*DOC, "n")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    later = runs.join(first, "run").where(F.col("first") != F.struct(*DOC, "n"))
    in_order = Window.partitionBy(*DOC).orderBy("from_pos", "to_pos")
    reached = F.max("to_pos").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reached.isNull() | (F.col("from_pos") > reached + 1)).cast("int")
    islands = later.select(*DOC, "from_pos", "to_pos").distinct().withColumn("opens", opens).withColumn("island", F.sum("opens").over(in_order))
    return islands.groupBy(*DOC, "island").agg(F.min("from_pos").alias("from_pos"), F.max("to_pos").alias("to_pos")).drop("island")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """(id_col, n_lines, removed_lines, removed_words, text) for every row: its text without the repeated runs.

    Of each repeated passage the first occurrence stays: a removed line always equals one that stands earlier and is
    kept. Lines without words count for nothing, and go only where they lie inside a removed run. Null texts count as
    empty and come back empty; rows that repeat id and text are one document and give equal results, one each; ids are
    whole numbers or null; an empty table gives no rows. Only DataFrame functions are used. Sums are formed before
    shuffles, fingerprints of frequent passages are join keys that adaptive execution splits.
    """
    spans = repeated_runs(docs, id_col, text_col, run_words).groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("from_pos", "to_pos"))).alias("spans"))
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    joined = keyed.join(spans, DOC, "left").withColumn("lines", _lines(F.col("text")))
    # What is left between the spans, each piece a slice of the lines.
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["to_pos"] + 1))
    ends = F.concat(F.transform("spans", lambda s: s["from_pos"]), F.array(F.size("lines")))
    pieces = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: s["b"] > s["a"])
    kept = F.array_join(F.transform(pieces, lambda s: F.array_join(F.slice("lines", s["a"] + 1, s["b"] - s["a"]), "\n")), "\n")
    out = joined.select("own_id", F.coalesce("text", F.lit("")).alias("before"), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("spans").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("text"))
    count = lambda c: F.regexp_count(c, F.lit(WORD_PATTERN)).cast("long")
    changed = F.col("before") != F.col("text")
    removed_lines = F.when(changed, F.col("n_lines") - F.when(F.col("text") == "", 0).otherwise(F.size(_lines(F.col("text"))))).otherwise(0).cast("long")
    removed_words = F.when(changed, count(F.col("before")) - count(F.col("text"))).otherwise(0).cast("long")
    return out.select(F.col("own_id").alias(id_col), "n_lines", removed_lines.alias("removed_lines"), removed_words.alias("removed_words"), "text")
