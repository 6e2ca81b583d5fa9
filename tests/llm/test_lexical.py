"""Ranked lexical search against SQL, and against plain Python on odd tables."""

import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import DATA, connection, spark_rows, sql_rows
from pitsight.llm import lexical, queries

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans(lexical.UPPER, lexical.LOWER)

DOCS = [
    (1, "Alpha beta beta, gamma", "x"), (2, "alpha", "x"), (3, None, "x"), (4, "", "x"), (5, "ALPHA Beta", "x"), (5, "ALPHA Beta", "x"), (5, "beta", "x"), (None, "alpha beta", "x"),
    (6, "--- !!", "x"), (7, "İ İstanbul ÄÖ äö", "x"), (8, "alpha\x00beta\x7fdelta", "x"), (9, "delta " * 30_000, "x"), (10, "common", "x"), (11, "common words", "x"), (12, "alpha", "x"),
]
ITEMS = [(1, "alpha beta alpha"), (2, None), (3, ""), (4, "nowhere"), (5, "DELTA common"), (5, "gamma"), (None, "Äö äö common"), (6, "words,words")]


def by_hand(docs, items, k=50):
    """The contract's words, one document and item at a time."""
    found = [(doc_id, Counter(PATTERN.findall((text or "").translate(UPPER)))) for doc_id, text, *_ in docs]
    found = [(doc_id, c) for doc_id, c in found if c]
    n_docs, n_terms = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for item_id, text in items:
        asked.setdefault(item_id, set()).update(PATTERN.findall((text or "").translate(UPPER)))
    rows = []
    for item_id, terms in asked.items():
        scores = []
        for doc_id, c in found:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id, score))
        rows += [(item_id, i + 1, doc_id, score) for i, (_, _, doc_id, score) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k])]
    return sorted(rows, key=repr)


def searched(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string, term string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.search(d, i, **more).collect()), key=repr)


def test_query_matches_its_sql(spark):
    assert spark_rows(queries.op11_search(spark, DATA)) == sql_rows(connection(), queries.ORACLES["op11_search"])


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=30))
def test_terms_are_the_matches_of_the_pattern(text):
    assert [t.decode() for t in lexical.terms(text.encode()) if t] == PATTERN.findall(text.translate(UPPER))


def test_nulls_repeats_ties_and_long_texts(spark):
    assert searched(spark, DOCS, ITEMS) == by_hand(DOCS, ITEMS)
    assert searched(spark, DOCS, ITEMS, k=2) == by_hand(DOCS, ITEMS, 2)


def test_item_terms_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 0)
    assert searched(spark, DOCS, ITEMS) == by_hand(DOCS, ITEMS)


def test_empty_tables(spark):
    assert searched(spark, [], ITEMS) == [] and searched(spark, DOCS, []) == [] and searched(spark, [(1, None, "x")], ITEMS) == []


def test_a_whole_index_serves_other_items(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, `n` string")
    index = lexical.write_index(docs.repartition(3), f"{tmp_path}/index")
    for items in (ITEMS, [(1, "beta")], [(2, "words of istanbul")]):
        asked = lexical.item_terms(spark.createDataFrame(items, "item_id long, text string"))
        assert sorted(map(tuple, lexical.ranked(index, asked).collect()), key=repr) == by_hand(DOCS, items)
    wanted = index.where("bucket = 7 and term = 'x'")
    assert "EqualTo(bucket,7), EqualTo(term,x)" in wanted._jdf.queryExecution().toString()


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "alpha", 2, 3), (2, "beta", 4, 5)], "`a.b` long, `te``xt` string, place int, bucket int")
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert [r["doc_id"] for r in lexical.search(docs, items, id_col="a.b", text_col="te`xt").collect()] == [1]
