import math
import zlib
from collections import Counter, defaultdict

import pytest
from pitsight.llm import ppm as P
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, key string, n int"
TEXTS = [
    "The cat sat on the mat. The cat sat.", "the dog sat on the log", "a cat and a dog", "", None, "  \t\n ", "THE CAT", "ein Hund saß auf der Matte",
    "the cat sat on the mat. the cat sat.", "zzz qqq unseen Wörter", "x" * 3000, "one", "one two", "one two three",
]
ROWS = [(i, t, "k", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (3, "again", "k", 1), (3, "again", "k", 1)]


def message(text):
    return " ".join((text or "").encode().lower().decode().split()).encode() + b"\n"


def counted(texts):
    """Counts of every byte after each of its contexts, as plain dictionaries."""
    counts = defaultdict(Counter)
    for text in texts:
        data = b"\n" * P.ORDER + message(text)
        for i in range(P.ORDER, len(data)):
            for k in range(P.ORDER + 1):
                counts[data[i - k : i]][data[i]] += 1
    return counts


def log10(counts, text):
    data, out = b"\n" * P.ORDER + message(text), 0.0
    for i in range(P.ORDER, len(data)):
        known = set()
        for k in range(P.ORDER, -1, -1):
            seen = counts.get(data[i - k : i])
            if seen is None:
                continue
            left = {b: n for b, n in seen.items() if b not in known}
            total = sum(left.values())
            if data[i] in left:
                out += math.log10((left[data[i]] - 0.5) / total)
                break
            if left:
                out += math.log10(len(left) / 2 / total)
            known = set(seen)
        else:
            out -= math.log10(256 - len(known))
    return out


def trained(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 != 2


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    from pitsight.llm.quality_net import training_fold

    model = P.fit(docs.where(training_fold(F.col("doc_id"), 7, 2)))
    return model, P.score(docs, model).collect()


def test_scores_are_those_of_a_plain_trie(scored):
    _, got = scored
    counts = counted([t for i, t, *_ in ROWS if trained(i)])
    tokens = Counter(w for i, t, *_ in ROWS if trained(i) for w in [*message(t).split(), "end"])
    n, v = sum(tokens.values()), len(tokens)
    wanted = []
    for i, t, *_ in ROWS:
        found = [*message(t).split(), "end"]
        base = sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in found)
        wanted.append((i if i is not None else -1, len(found), sum(w in tokens for w in found), base, log10(counts, t)))
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got)
    for a, b in zip(found, sorted(wanted), strict=True):
        assert a[:3] == b[:3]
        assert a[3:] == pytest.approx(b[3:], rel=1e-5)


def test_training_counts(scored):
    model, _ = scored
    tokens = Counter(w for i, t, *_ in ROWS if trained(i) for w in [*message(t).split(), "end"])
    assert (model.train_tokens, model.vocabulary) == (sum(tokens.values()), len(tokens))


def test_probabilities_of_next_bytes_sum_to_one():
    import numpy as np

    codes = np.concatenate([c for t in TEXTS for c in P.grams(message(t))])
    codes, n = np.unique(codes, return_counts=True)
    trie = P.Trie(codes, n)
    for context in (b"e cat", b"zzzzz", b"\n\n\n\n\n", b"xxxxx", b"t sat"):
        high = int.from_bytes(context, "big") << 8
        every = np.array([high | b for b in range(256)], np.uint64)
        assert (10.0 ** trie.log10(every)).sum() == pytest.approx(1, rel=1e-5)


def test_rare_contexts_left_out_and_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    small = P.fit(docs, max_nodes=50)
    assert all(r["score"] < 0 for r in P.score(docs, small).collect())
    nothing = spark.createDataFrame([], SCHEMA)
    model = P.fit(nothing)
    assert P.score(nothing, model).count() == 0
    scores = {r["doc_id"]: r["score"] for r in P.score(docs.where("doc_id = 11"), model).collect()}
    assert scores[11] == pytest.approx(-4 * math.log10(256))


@pytest.mark.parametrize("most", [0, 1, 50])
def test_scores_do_not_depend_on_what_tasks_hold(spark, most):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    train = docs.where("doc_id % 3 = 0")
    got = P.score(docs, P.fit(train, max_nodes=most)).collect()
    counts = counted([t for i, t, *_ in ROWS if i is not None and i % 3 == 0])
    wanted = sorted((i if i is not None else -1, log10(counts, t)) for i, t, *_ in ROWS)
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["score"]) for r in got)
    assert [i for i, _ in found] == [i for i, _ in wanted]
    assert [x for _, x in found] == pytest.approx([x for _, x in wanted], rel=1e-5)
