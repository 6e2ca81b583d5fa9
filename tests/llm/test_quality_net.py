import random
import zlib

import numpy as np
import pytest
from pitsight.llm import quality_net as Q
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, score string, quality string"
WORDS = "ing tion the er and re he in on at nd st es en of te ed or ti hi as to".split()


def document(rng, good):
    words = ["".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
    if good:
        return " ".join(w.capitalize() + "." if k % 9 == 8 else w for k, w in enumerate(words))
    return " ".join(w + "###" for w in words) if rng.random() < 0.5 else " ".join([words[0]] * len(words))


def table(spark, n=600):
    rng = random.Random(4)
    y = [int(rng.random() < 0.7) for _ in range(n)]
    docs = [(i, document(rng, y[i]), "s", None) for i in range(n)]
    return docs, spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)], "doc_id long, quality int, toxic int"), y


def test_held_out_accuracy_and_reruns(spark):
    docs, labels, y = table(spark)
    frame = spark.createDataFrame(docs, SCHEMA)
    in_fold = Q.training_fold(F.col("doc_id"))
    model = Q.fit(frame, labels.where(in_fold))
    got = {r["doc_id"]: r["score"] for r in Q.score(frame, model).collect()}
    held = [i for i in range(len(docs)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == y[i] for i in held]) > 0.95
    p = np.clip([got[i] if y[i] else 1 - got[i] for i in held], 1e-9, 1)
    assert -np.log(p).mean() < 0.2
    again = Q.score(frame.repartition(5), Q.fit(frame.repartition(3), labels.where(in_fold)))
    assert {r["doc_id"]: r["score"] for r in again.collect()} == got


def test_labels_outside_of_the_fold_do_not_matter(spark):
    docs, labels, _ = table(spark, 200)
    frame, in_fold = spark.createDataFrame(docs, SCHEMA), Q.training_fold(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(in_fold, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (Q.score(frame, Q.fit(frame, x.where(in_fold))).orderBy("doc_id").collect() for x in (labels, turned))
    assert [r["score"] for r in a] == [r["score"] for r in b]


def test_scores_are_those_of_the_features(spark):
    docs, labels, _ = table(spark, 150)
    docs += [(None, None, None, None), (151, "", "", ""), (152, "ab " * 40_000, "", ""), (152, "ab " * 40_000, "", "")]
    frame = spark.createDataFrame(docs, SCHEMA)
    model = Q.fit(frame, labels)
    got = Q.score(frame, model).collect()
    assert len(got) == len(docs) and Q.score(frame, model).columns == ["doc_id", "text", "quality", "score"]
    index = Q.index_vectors()
    for r in got:
        x = Q.pooled((r["text"] or "").encode().split(), model.vectors, index, Q.Rows())[None, :]
        assert r["score"] == pytest.approx(float(model.probabilities(x)[0]), abs=1e-4)
    kept = Q.score(frame, model, score_col="p", threshold=0.5)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["score"] >= 0.5)


def test_context_vectors_by_brute_force(spark):
    rng = random.Random(6)
    texts = [document(rng, True) for _ in range(40)] + ["one", "", None, "two words", "a " * 200]
    index, rows = Q.index_vectors(), Q.Rows()
    total = np.zeros((Q.WORD_ROWS + Q.SHAPE_ROWS, Q.WIDTH))
    for text in texts:
        tokens = (text or "").encode().split()
        of = rows.of(tokens) if tokens else np.zeros((2, 0), int)
        for i in range(len(tokens)):
            near = [j for j in range(len(tokens)) if 0 < abs(i - j) <= Q.WINDOW]
            sum_ = sum((index[of[0][j]] + index[of[1][j]] for j in near), np.zeros(Q.WIDTH))
            total[of[0][i]] += sum_
            total[of[1][i]] += sum_
    wanted = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert np.allclose(Q.context_vectors(frame), wanted, atol=1e-6)


def test_no_labels_one_class_and_empty_tables(spark):
    docs, labels, _ = table(spark, 60)
    frame = spark.createDataFrame(docs, SCHEMA)
    assert {r["score"] for r in Q.score(frame, Q.fit(frame, labels.limit(0))).collect()} == {0.5}
    ones = Q.fit(frame, labels.withColumn("quality", F.lit(1)))
    assert np.mean([r["score"] for r in Q.score(frame, ones).collect()]) > 0.5
    assert Q.score(frame.limit(0), ones).count() == 0
    doubtful = labels.union(spark.createDataFrame([(1, None, None), (None, 1, 0), (1, 0, 0), (999, 1, 1)], labels.schema))
    assert Q.score(frame, Q.fit(frame, doubtful)).count() == len(docs)
