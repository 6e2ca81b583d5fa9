import random

import numpy as np
import pytest
import xxhash
from pitsight.llm import components, simhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, fp string"


def plain(text, n=3):
    tokens = (text or "").encode().lower().split()
    items = [b" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)] or ([b" ".join(tokens)] if tokens else [])
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in items) > len(items):
            out |= 1 << bit
    return out


def brute(rows):
    fps = [plain(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    lowest = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], f"{fps[i]:016x}", lowest[find(i)]) for i in range(len(rows))), key=str)


def run(spark, rows):
    got = simhash.near_duplicate_groups(spark.createDataFrame(rows, DOCS))
    return sorted(((r[0], r[1], r[2]) for r in got.select("doc_id", simhash.fingerprint_text(F.col("fp")), "component_id").collect()), key=str)


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    out = []
    for text in base:
        out.append(text)
        for _ in range(rng.randint(0, 4)):
            tokens = text.split()
            tokens[rng.randrange(len(tokens))] = rng.choice(vocabulary)
            out.append(" ".join(tokens) if rng.random() < 0.7 else text)
    return out


def test_matches_brute_force_with_odd_rows(spark):
    rows = [(i, t, "en", "x") for i, t in enumerate(texts())]
    rows += [(900, None, None, None), (901, "", "en", "x"), (902, " \n\t", "en", "x"), (903, "One", "en", "x"), (904, "one two", "en", "x"), (None, rows[0][1], "en", "x"), (905, rows[0][1].upper(), "en", "x"), rows[3], rows[3]]
    rows.append((906, " ".join("z%d" % i for i in range(70_000)), "en", "x"))
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_crowded_cells_keep_every_link(spark, monkeypatch):
    """With cells of two as the limit nearly all links come over the one-bit neighbours."""
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(3)]
    values = set()
    for c in centre:
        walk = c
        for _ in range(60):
            walk ^= 1 << rng.randrange(64)
            values.add(walk)
    values = [simhash._signed(v) for v in values]
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for limit in (2, 48):
        monkeypatch.setattr(simhash, "CELL_PAIRS", limit)
        edges = {(r["a"], r["b"]) for r in simhash.similar_fingerprints(frame).collect()}
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in edges)
        assert groups(values, edges) == groups(values, {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2})


def groups(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, out.values()))


def test_manhattan_distance_of_embeddings_is_a_lower_bound(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(1 << 63), 1 << 63, (500, 2))]
    frame = spark.createDataFrame(pairs, "a long, b long")
    got = frame.select("a", "b", F.bit_count(simhash.thermometer(F.col("a")).bitwiseXOR(simhash.thermometer(F.col("b")))).alias("d")).collect()
    for r in got:
        a, b = r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1
        counts = [[bin(x >> 2 * i & 3).count("1") for i in range(32)] for x in (a, b)]
        assert r["d"] == sum(abs(x - y) for x, y in zip(*counts)) <= bin(a ^ b).count("1")


def test_components_of_a_long_chain(spark):
    from pitsight.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def similar(a, b, n=5):
    sets = []
    for text in (a, b):
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    both = len(sets[0] & sets[1])
    return both >= 0.8 * (len(sets[0]) + len(sets[1]) - both)


def stay(rows):
    """Rows that a plain search over all pairs keeps."""
    rows = list(dict.fromkeys(rows))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(rows[i][1], rows[j][1]):
                root[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row)
    return sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()), key=str)


def near_texts(seed=8):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        base = ["v%d" % rng.randrange(900) for _ in range(rng.randint(40, 400))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(max(1, len(base) // 60)):
                copy[rng.randrange(len(copy))] = "new%d" % rng.randrange(99)
            out.append(" ".join(copy))
    return out


def test_keep_one_of_each_is_a_plain_search(spark):
    rows = [(i, t, "en", "x") for i, t in enumerate(near_texts())]
    rows += [(500, None, None, None), (501, "", "en", "x"), (None, rows[0][1], "en", "x"), (502, rows[0][1].upper(), "en", "x"), (503, "short", "", ""), (503, "short", "", ""), (504, "w " * 60_000, "", "")]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "fp"]
    got, wanted = sorted((r["doc_id"] for r in kept.collect()), key=str), stay(rows)
    # Nothing unlike all others goes, and of the copies nine tenths at least.
    total = len(set(rows))
    assert set(wanted) <= set(got) and total - len(got) >= 0.9 * (total - len(wanted)) and len(wanted) < 0.6 * total


def test_rows_are_told_apart_by_all_columns(spark):
    texts = [" ".join(f"{c}{i}" for i in range(50)) for c in "abcd"]
    rows = [(1, texts[0], "en", "x"), (5, texts[1], "en", "x"), (5, texts[2], "en", "x"), (7, texts[1], "en", "x"), (7, texts[3], "en", "x"), (1, texts[0], "en", "x"), (1, texts[0], "fr", "x")]
    got = simhash.keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(1, texts[0]), (5, texts[1]), (5, texts[2]), (7, texts[3])])
    assert simhash.keep_one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_crowded_cells_of_near_copies(spark, monkeypatch):
    """A group of near copies of one text, larger than what a cell compares in pairs."""
    rng, base = random.Random(3), ["v%d" % i for i in range(600)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(600)] = "n%d" % i
        rows.append((i, " ".join(copy), "en", "x"))
    monkeypatch.setattr(simhash, "NEAR_CELL", 4)
    assert [r["doc_id"] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect()] == [0]


@pytest.mark.parametrize("count", [0, 1])
def test_groups_have_one_row_a_document(spark, count):
    assert len(run(spark, [(1, "a b c", "en", "")] * count)) == count


def test_size_estimates_of_components_do_not_grow_by_round(spark):
    chain = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    found = components.connected_components(chain)
    assert found.count() == 201 and found.where("root != 0").isEmpty()
    assert int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 40


def variants(seed, n=250, strangers=200):
    """Variants of one text, one to five of its words replaced, among strangers."""
    rng = random.Random(seed)
    base = ["v%d" % rng.randrange(900) for _ in range(150)]
    out = [" ".join("s%d" % rng.randrange(5000) for _ in range(150)) for _ in range(strangers)]
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(1, 5)):
            copy[at] = "n%d" % rng.randrange(100_000)
        out.append(" ".join(copy))
    return [(i, text, "en", "x") for i, text in enumerate(out)]


def test_no_link_is_lost_in_a_dense_group(spark):
    """Many pairs of such a group are just above or just below the similarity; it takes few jobs."""
    rows, context = variants(11), spark.sparkContext
    context.setJobGroup("dense", "")
    got = sorted(r["doc_id"] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect())
    jobs = len(context.statusTracker().getJobIdsForGroup("dense"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert got == sorted(stay(rows))
    assert jobs < 250


def test_sketches_exclude_no_similar_pair(spark):
    rows = near_texts(4) + [r[1] for r in variants(5, 20, 5)] + ["", "one", "w " * 3000]
    found = simhash.profiles(spark.createDataFrame([(t,) for t in rows], "text string")).withColumn("point", F.monotonically_increasing_id())
    texts = dict(spark.createDataFrame([(t,) for t in rows], "text string").select(simhash.text_key(F.col("text")), "text").collect())
    points = found.dropDuplicates(["key"]).cache()
    keys = {r["point"]: r["key"] for r in points.collect()}
    pairs = simhash._of(points, "a").crossJoin(simhash._of(points, "b")).where("a < b")
    open_ = {(r["a"], r["b"]) for r in pairs.where(simhash.may_be_similar(0.8)).select("a", "b").collect()}
    every = [(a, b) for a in keys for b in keys if a < b]
    wanted = {(a, b) for a, b in every if similar(texts[keys[a]], texts[keys[b]])}
    assert wanted <= open_ and len(open_) < 0.2 * len(every)


def test_every_open_pair_of_a_crowded_cell_meets(spark, monkeypatch):
    """Blocks of three: every pair of two components comes once, none of one component, none with the leader."""
    monkeypatch.setattr(simhash, "NEAR_CELL", 3)
    sketch = {f"s{k}": F.lit(0).cast("long") for k in range(simhash.SKETCH)}
    points = spark.range(20).select(F.col("id").alias("point"), F.lit(9).cast("long").alias("size"), *(c.alias(k) for k, c in sketch.items()))
    cells = points.select(F.lit(7).cast("long").alias("cell"), "point", F.lit(20).cast("long").alias("n"), F.lit(0).cast("long").alias("leader"))
    roots = spark.createDataFrame([(i, 0) for i in range(8)], "node long, root long")
    got = sorted((r["a"], r["b"]) for r in simhash.open_pairs(cells, roots, points, 0.8).collect())
    assert got == [(a, b) for a in range(1, 20) for b in range(a + 1, 20) if b >= 8]
