import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pitsight.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size int, rate string, row int"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected(rows):
    """Targets by taking limited sources out one round at a time, then each row's copies."""
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += size(r[1])
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    return sizes, target


ROWS = [(i, "word " * (1 + i * 7 % 40), ["a", "b", "c", "d"][(i * i) % 4 if i % 5 else 0], i, "x", 1) for i in range(400)]
ODD = [(None, None, None, None, None, None), (1, "", "empty", 1, "", 1), (900, "x " * 50_000, "long", 1, "", 1), (901, "one two", None, 1, "", 1), (901, "one two", None, 1, "", 1), (902, "a\tb\x0bc", "d", 1, "", 1)]


@pytest.mark.parametrize("rows", [ROWS, ROWS + ODD, ODD])
def test_mixture(spark, rows):
    sizes, target = expected(rows)
    got = M.mixture(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[2], size(r[1])) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert r["taken"] in (r["size"] * int(rate + 1e-12), r["size"] * (int(rate + 1e-12) + 1)) and r["taken"] <= 3 * r["size"]
        if r["doc_id"] is not None and abs(rate - round(rate)) > 1e-9:
            chance = int(hashlib.md5(f"{r['doc_id']}:{M.SEED}".encode()).hexdigest()[:8], 16) / 2**32
            assert r["taken"] == r["size"] * (int(rate) + (chance < rate - int(rate)))
        taken[r["source"]] += r["taken"]
    for s, wanted in target.items():
        largest = max(size(r[1]) for r in rows if r[2] == s)
        assert abs(taken[s] - wanted) <= 4 * (largest * max(sizes[s], 1)) ** 0.5 + largest


def test_copies_are_those_of_the_mixture(spark):
    docs = spark.createDataFrame(ROWS + ODD, SCHEMA)
    taken = {(r["doc_id"], r["source"]): r["taken"] for r in M.mixture(docs).collect() if r["size"] and r["doc_id"] != 901}
    copies = Counter((r["doc_id"], r["source"]) for r in M.mixed(docs).select("doc_id", "source").collect())
    of = {(r[0], r[2]): size(r[1]) for r in ROWS + ODD}
    assert {k: v // of[k] for k, v in taken.items() if v} == {k: n for k, n in copies.items() if of[k] and k[0] != 901}
    assert M.mixed(docs).columns == docs.columns
    assert sorted(M.mixed(docs).collect(), key=str) == sorted(M.mixed(docs.repartition(3)).collect(), key=str)


def test_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert M.mixture(nothing).count() == 0 and M.mixed(nothing).count() == 0
