"""Every stage of the pipeline against a plain search on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pitsight.llm import quality_net, queries, simhash
from pitsight.llm.common import shingles, words
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) rows of every stage."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        assert k == len(corpus_pipeline.STAGES) - 1 or after.columns == docs.columns
        out.append((docs.collect(), after.collect()))
        docs = after
    return out


def rows(found):
    return Counter((r["doc_id"], r["text"]) for r in found)


def test_classifier_keeps_good_documents(spark, stages):
    before, after = stages[0]
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    assert not rows(after) - rows(before) and len(after) < len(before)
    right = [(r["doc_id"] in kept) == quality[r["doc_id"]] for r in before if r["doc_id"] in quality]
    assert np.mean(right) > 0.9
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where(quality_net.training_fold(F.col("doc_id")))
    scores = quality_net.score(docs, quality_net.fit(docs, labels)).collect()
    assert kept == {r["doc_id"] for r in scores if r["score"] >= 0.5}


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    sets = [frozenset(shingles(words((r["text"] or "").encode().lower()), 5)) for r in before]
    root = list(range(len(before)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both) - 1e-9:
                x, y = sorted((top(i), top(j)), key=lambda k: before[k]["doc_id"])
                root[y] = x
    assert {r["doc_id"] for r in after} == {before[i]["doc_id"] for i in range(len(before)) if top(i) == i}
    assert not rows(after) - rows(before)


def test_every_stage_takes_odd_tables(spark):
    """Empty tables, null ids and texts, repeated rows and ids, other columns."""
    names = "doc_id long, text string, lang string, source string, n_chars long, shard string, score double, key string"
    long = " ".join(f"w{i}" for i in range(60_000))
    odd = [(None, None, None, None, None, None, None, None), (1, "", "en", "a", 0, "s", 0.5, "k"), (1, "one two three four five six", "en", "a", 1, "s", 0.5, "k"),
           (1, "one two three four five six", "en", "a", 1, "s", 0.5, "k"), (2, long, "en", None, 2, "s", 0.5, "k"), (None, "some other words here", "en", "b", 2, "s", 0.5, "k")]
    for data in ([], odd):
        docs = spark.createDataFrame(data, names)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            found = out.collect()
            assert bool(found) <= bool(data)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
            assert {(r["doc_id"], r["text"]) for r in found} <= {(r["doc_id"], r["text"]) for r in docs.collect()}
    kept = corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()
    assert len(kept) == 4


def test_documents_with_benchmark_items_go(spark, stages):
    before, after = stages[2]
    items = [set(shingles(words(r["text"].encode().lower()), 5)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = Counter()
    for r in before:
        held = set(shingles(words((r["text"] or "").encode().lower()), 5))
        if not any(item and len(item & held) >= 0.8 * len(item) - 1e-9 for item in items):
            kept[r["doc_id"], r["text"]] += 1
    assert rows(after) == kept


def test_mix_takes_whole_copies(stages):
    before, after = stages[3]
    sizes, taken = defaultdict(int), defaultdict(int)
    for found, total in ((before, sizes), (after, taken)):
        for r in found:
            total[r["source"]] += len(words((r["text"] or "").encode()))
    copies = Counter(r["doc_id"] for r in after)
    by_source = defaultdict(set)
    for r in before:
        by_source[r["source"]].add(copies[r["doc_id"]])
    assert all(max(n) - min(n) <= 1 and max(n) <= 3 for n in by_source.values())
    assert 0.7 < sum(taken.values()) / sum(sizes.values()) < 1.3
    assert set(rows(after)) <= set(rows(before))


def test_shards_are_even(stages):
    before, after = stages[4]
    assert rows(after) == rows(before)
    size, largest = defaultdict(int), 0
    for r in after:
        n = len((r["text"] or "").encode()) + 8
        size[r["shard"]] += n
        largest = max(largest, n)
    assert set(size) <= set(range(24))
    assert max(size.values()) - sum(size.values()) / 24 <= 3 * largest


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert Counter((r["doc_id"], r["shard"]) for r in got.collect()) == Counter((r["doc_id"], r["shard"]) for r in stages[4][1])


#: Queries whose rows are lists of answers; their own tests hold them against SQL.
SEARCHES = {"op11_search", "op12_topk", "op13_hard_negatives"}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - SEARCHES))
def test_queries_return_a_row_for_each_document(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/{'pages' if name == 'op2_html' else 'documents'}.parquet").count()
    assert got.count() == n or name == "op5_decontaminate"
