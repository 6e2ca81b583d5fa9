"""Exact top-k search and hard negatives against SQL, and against plain Python on odd tables and several shards."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import DATA, connection, spark_rows, sql_rows
from pitsight.llm import hard_negatives, queries, vector_search
from pitsight.llm import vectors as V

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, place string"


def table(n=260, d=6, seed=3):
    """Vectors of five labels, with ties, repeated rows and ids, null ids and labels, another length, and unsound ones."""
    r = random.Random(seed)
    rows = [(i, [r.choice([-1.0, -0.5, 0.25, r.gauss(0, 0.3)]) for _ in range(d)], r.choice([0, 0, 1, 2, 9]), "x") for i in range(n)]
    rows += [(100, rows[3][1], 1, "x"), rows[0], rows[0], (None, rows[4][1], 2, "x"), (None, rows[5][1], None, "x"), (14, rows[6][1], None, "x")]
    rows += [(300, [0.5, 0.25], 1, "x"), (301, [0.5, 0.5], 1, "x"), (302, [1.0, 0.25], 2, "x"), (400, [], 0, "x"), (401, [], 0, "x")]
    rows += [(500, None, 1, "x"), (501, [NAN] * d, 1, "x"), (502, [INF] * d, 1, "x"), (600, [None] * d, 1, "x")]
    rows += [(700 + i, [0.5] * d, 2, "x") for i in range(40)]
    return rows


def sound(rows, scale):
    return [(i, [math.floor(scale * float(np.float32(x))) for x in e], label) for i, e, label, _ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def last(i):
    return (i is None, i or 0)


def top_by_hand(rows, k=10, scale=1024):
    kept, out = sound(rows, scale), []
    for q, (i, e, _) in enumerate(kept):
        if i is None or i % 100:
            continue
        found = sorted(((-dot(e, f), last(j), j) for c, (j, f, _) in enumerate(kept) if c != q and len(f) == len(e)))
        out += [(i, n + 1, j, -s) for n, (s, _, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def relabelled(i, label):
    return label if label is None or i is None or i % 7 else (label + 1) % 10


def mined_by_hand(rows, low=30, high=90):
    kept = [(i, e, relabelled(i, label)) for i, e, label in sound(rows, 256) if label is not None]
    out = []
    for q, (i, e, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = sorted((-dot(e, f), last(j), j, m) for c, (j, f, m) in enumerate(kept) if c != q and len(f) == len(e))
        for s, _, j, _ in [x for x in scored if x[3] == label][:5]:
            window = [(t, u) for t, _, u, m in scored if m != label and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, n + 1, u, -s, -t) for n, (t, u) in enumerate(window[:10])]
    return sorted(out, key=repr)


def label_column():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("name", ["op12_topk", "op13_hard_negatives"])
def test_query_matches_its_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, DATA)) == sql_rows(connection(), queries.ORACLES[name])


@pytest.mark.parametrize("shard_bytes", [1 << 20, 700])
def test_top_k_of_odd_tables(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(V, "TILE_ROWS", 37)
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = vector_search.search(df, F.col("id") % 100 == 0, shard_bytes=shard_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == top_by_hand(rows)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 900])
def test_hard_negatives_of_odd_tables(spark, shard_bytes):
    rows = table(seed=8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = hard_negatives.mine(df, label_column(), F.col("id") % 100 == 0, shard_bytes=shard_bytes)
    wanted = mined_by_hand(rows)
    assert wanted and sorted(map(tuple, got.collect()), key=repr) == wanted


def test_empty_tables_and_no_queries(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(table()[1:50], SCHEMA)
    for df in (none, some):
        assert vector_search.search(df, F.col("id") == -5).collect() == []
        assert hard_negatives.mine(df, label_column(), F.col("id") == -5).collect() == []


def test_products_are_exact_beyond_doubles_and_longs():
    rng = np.random.default_rng(1)
    for most in (1 << 10, 1 << 28, 1 << 40, (1 << 63) - 1):
        a, b = rng.integers(-most, most, (5, 3)), rng.integers(-most, most, (7, 3))
        exact = [[max(min(dot(map(int, x), map(int, y)), V.LONG_MAX), -V.LONG_MAX) for y in b] for x in a]
        assert V.products(a, b).tolist() == exact
        q, r = (m.ravel() for m in np.indices((5, 7)))
        assert hard_negatives.scored(a, b, q, r).tolist() == [s for row in exact for s in row]


def test_components_beyond_a_long_are_its_ends(spark):
    df = spark.createDataFrame([(0, [1e30, 0.0], 1), (1, [1.0, 5.0], 1), (2, [1e30, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = vector_search.search(df, F.col("id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, V.LONG_MAX), (2, V.LONG_MAX)]


def test_bounds_hold_and_rule_out_most_rows():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(0, 0.125, (4000, 64))).astype(np.int64)
    asked = rows[:9]
    least, greatest = hard_negatives.Approximation.of(rows).bounds(asked, slice(0, len(rows)))
    exact = rows @ asked.T
    assert (least <= exact).all() and (exact <= greatest).all()
    scored = []
    original = hard_negatives.scored
    try:
        hard_negatives.scored = lambda a, b, q, r: (scored.append(len(q)), original(a, b, q, r))[1]
        low, high = np.full(9, 2000), np.full(9, 12000)
        q, r, s = hard_negatives.window_top(asked, np.arange(9), np.arange(9), low, high, hard_negatives.Approximation.of(rows), rows, np.arange(4000), np.arange(4000), 10)
    finally:
        hard_negatives.scored = original
    for i in range(9):
        wanted = sorted((-int(x), j) for j, x in enumerate(exact[:, i]) if j != i and 2000 <= x <= 12000)[:10]
        assert [(-int(s[n]), int(r[n])) for n in np.flatnonzero(q == i)] == wanted
    assert sum(scored) < 0.1 * exact.size


def test_lists_are_merged_up_a_tree(spark):
    lists = spark.createDataFrame([(1, s, i, 1000 - (7 * i) % 50) for s in range(40) for i in range(s, s + 3)], "place long, shard int, id long, score long")
    got = V.merged(lists, ["place"], 40, 5, fan_in=3).orderBy("rank").collect()
    wanted = sorted((-(1000 - (7 * i) % 50), i) for s in range(40) for i in range(s, s + 3))[:5]
    assert [(-r["score"], r["id"]) for r in got] == wanted and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
