import random

import pytest
from pitsight.llm import decontamination as D

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, n_shared int"


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(docs, items, share=0.8):
    out = set()
    for d, text, *_ in docs:
        held = shingles(text)
        for i, wanted, *_ in items:
            w = shingles(wanted)
            if i is not None and w and len(w & held) >= share * len(w) - 1e-9:
                out.add((d, i, len(w), len(w & held)))
    return out


def make(seed=4):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(300)
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 20, 40, 90]))), None) for i in range(60)]
    docs = []
    for d in range(120):
        tokens = [word() for _ in range(rng.choice([0, 4, 50, 400]))]
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = word()
            at = rng.randint(0, len(tokens))
            tokens[at:at] = part
        docs.append((d, " ".join(tokens).title() if rng.random() < 0.3 else "\n".join(tokens), "z"))
    docs += [(900, None, None), (901, "", "z"), (None, items[4][1], "z"), (902, items[0][1], "z"), (903, " ".join("q%d" % i for i in range(80_000)) + " " + items[6][1], "z"), docs[2], docs[2]]
    items += [(70, None, 1), (71, " ", 1), (None, items[3][1], 1), items[5], (72, items[5][1], 1)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 2000])
def test_matches_brute_force(spark, block_bytes):
    docs, items = make()
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = D.contaminated(a, b, block_bytes=block_bytes)
    rows = [(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in got.collect()]
    assert set(rows) == brute(docs, items)
    clean = D.without_contaminated(a, b, block_bytes=block_bytes)
    bad = {r[0] for r in brute(docs, [(i if i is not None else -1, *rest) for i, *rest in items])}
    assert clean.columns == a.columns
    assert sorted((tuple(r) for r in clean.collect()), key=str) == sorted((d for d in docs if d[0] not in bad), key=str)


def test_empty_tables(spark):
    docs, items = make()
    none, nothing = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert D.contaminated(none, spark.createDataFrame(items, ITEMS)).count() == 0
    assert D.contaminated(spark.createDataFrame(docs, DOCS), nothing).count() == 0
    assert D.without_contaminated(spark.createDataFrame(docs, DOCS), nothing).count() == len(docs)


def test_signature_outnumbers_what_may_be_missing():
    _, items = make()
    index = D.Index([(i, (t or "").encode()) for i, t, _ in items], 5, 0.8)
    assert min(index.needed) >= 1


def test_a_very_long_item_takes_little_memory():
    import tracemalloc

    text = " ".join(f"t{i}" for i in range(100_000)).encode()
    tracemalloc.start()
    index = D.Index([(1, text), (2, b"a few words of another item here")], 5, 0.8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20 and min(index.needed) >= 1
    assert [h[0] for h in index.hits(b"before " + text + b" behind")] == [1]


@pytest.mark.parametrize("kind", ["decimal(12,2)", "string", "date", "int"])
def test_item_ids_of_any_type_and_clashing_names(spark, kind):
    from pyspark.sql import functions as F

    docs, items = make()
    a = spark.createDataFrame(docs, DOCS).withColumnRenamed("doc_id", "n_shared")
    value = F.date_add(F.lit("2020-01-01").cast("date"), F.col("item_id").cast("int")) if kind == "date" else F.col("item_id").cast(kind)
    b = spark.createDataFrame(items, ITEMS).select(value.alias("n_shared"), "text")
    got = D.contaminated(a, b, id_col="n_shared", item_col="n_shared")
    assert got.columns == ["n_shared", "benchmark_n_shared", "n_shingles", "text_n_shared", "containment"]
    assert dict(got.dtypes)["benchmark_n_shared"] == kind
    assert {(r[0], r[2], r[3]) for r in got.collect()} == {(d, n, m) for d, _, n, m in brute(docs, items)}
