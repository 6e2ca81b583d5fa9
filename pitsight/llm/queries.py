"""The queries over the corpus tables: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hard_negatives, html_text, lexical, line_dedup, line_quality, mixing, ppm, quality_net, resharding, simhash, vector_search, wordpiece
from .common import table

OLD_SHARDS, SHARDS = 20, 24


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    automaton = wordpiece.Automaton(*wordpiece.vocabulary())
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), automaton)


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = resharding.assignment(table(spark, sf_dir, "documents"), OLD_SHARDS, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality.evaluate(table(spark, sf_dir, "documents"), with_text=False)
    return judged.select("doc_id", *line_quality.FIELDS[:-1])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    in_fold = quality_net.training_fold(F.col("doc_id"))
    model = quality_net.fit(docs, labels.where(in_fold))
    scored = quality_net.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (~in_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trained = quality_net.training_fold(F.col("doc_id"), 7, 2)
    model = ppm.fit(docs.where(trained))
    scored = ppm.score(docs, model)
    return scored.select("doc_id", (~trained).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_html, op3_wordpiece, op4_reshard, op5_decontaminate, op6_line_quality, op7_quality, op8_mix, op9_line_dedup, op10_ppm, op11_search, op12_topk, op13_hard_negatives)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHINGLES = (
    "CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] "
    "ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END"
)


def _shingle_sql(name: str, id_col: str, source: str) -> str:
    return (
        f"{name}_w AS (SELECT {id_col}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {source}), "
        f"{name} AS (SELECT DISTINCT {id_col}, unnest({SHINGLES}) AS s FROM {name}_w)"
    )


def _vector_sql(scale: int, label: str) -> str:
    return (
        f"SELECT row_number() OVER () AS place, vec_id, {label} AS label, list_transform(embedding, lambda y: floor({scale} * CAST(y AS DOUBLE))) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = len(embedding)"
    )


#: Exact, as all sums are whole numbers far below 2^53.
PRODUCT = "CAST(list_dot_product(q.x, c.x) AS BIGINT)"

ORACLES = {
    "op5_decontaminate": f"""
WITH {_shingle_sql("d", "doc_id", "documents")}, {_shingle_sql("b", "item_id", "benchmark")},
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b ON b.s = d.s GROUP BY doc_id, item_id)
SELECT doc_id, h.item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM h JOIN n ON n.item_id = h.item_id
WHERE n_shingles - n_shared <= floor(n_shingles * (1 - 0.8e0) + 1e-9)""",
    "op8_mix": """
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':mix-1'), 1, 8) AS BIGINT) / 4294967296e0 AS chance FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM z GROUP BY source),
c AS (SELECT *, 3 * source_size AS most, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
  coalesce(sum(3 * source_size) OVER p, 0) AS most_before, coalesce(sum(weight) OVER p, 0) AS weight_before
  FROM s WINDOW p AS (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(most AS DOUBLE) * CAST(weights - weight_before AS DOUBLE) < CAST(weight AS DOUBLE) * CAST(total - most_before AS DOUBLE) AS limited FROM c),
r AS (SELECT *, total - coalesce(sum(most) FILTER (WHERE limited) OVER (), 0) AS rest, weights - coalesce(sum(weight) FILTER (WHERE limited) OVER (), 0) AS weight_left FROM l),
t AS (SELECT source, source_size, CASE WHEN limited THEN CAST(most AS DOUBLE) ELSE CAST(rest * weight AS DOUBLE) / CAST(greatest(weight_left, 1) AS DOUBLE) END AS target FROM r),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate FROM t)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM z JOIN q ON z.source IS NOT DISTINCT FROM q.source""",
    "op11_search": f"""
WITH t AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
d AS (SELECT place, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM t WHERE len(ts) > 0),
z AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
p AS (SELECT place, doc_id, n, term, count(*) AS tf FROM (SELECT place, doc_id, n, unnest(ts) AS term FROM d) GROUP BY ALL),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000e0 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, z WHERE term IN (SELECT term FROM i) GROUP BY term, n_docs),
s AS (SELECT item_id, place, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN p USING (term), z GROUP BY item_id, place, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50""",
    "op12_topk": f"""
WITH v AS ({_vector_sql(1024, "NULL")}),
s AS (SELECT q.place, q.vec_id AS query_id, c.vec_id, {PRODUCT} AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.place <> c.place AND len(q.x) = len(c.x))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op13_hard_negatives": f"""
WITH v AS (SELECT * FROM ({_vector_sql(256, "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")}) WHERE label IS NOT NULL),
s AS (SELECT q.place AS a, q.vec_id AS anchor_id, c.place, c.vec_id, q.label = c.label AS same, {PRODUCT} AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.place <> c.place AND len(q.x) = len(c.x)),
p AS (SELECT a, anchor_id, place AS b, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, place) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id) AS r
  FROM p JOIN s ON s.a = p.a AND NOT same WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 10""",
}
