import random

from pitsight.llm import line_dedup as L

SCHEMA = "doc_id long, text string, digest string, n int"


def expected(docs, run_words):
    """Plain search: lines that lie in a run of at least run_words words that stands earlier."""
    seen, out = [], {}
    for i, text in docs:
        lines = (text or "").split("\n")
        at = [k for k, line in enumerate(lines) if line.split()]
        mine = [lines[k].strip(" \t\n\v\f\r") for k in at]
        gone = set()
        for other in [*seen, mine]:
            for shift in range(-len(other), len(mine)) if other is not mine else range(1, len(mine)):
                n = max(0, shift)
                while n < len(mine) and n - shift < len(other):
                    end, words = n, 0
                    while end < len(mine) and end - shift < len(other) and mine[end] == other[end - shift]:
                        words += len(mine[end].split())
                        end += 1
                    if words >= run_words:
                        gone |= set(range(at[n], at[end - 1] + 1))
                    n = max(end, n + 1)
        seen.append(mine)
        out[i] = "\n".join(line for k, line in enumerate(lines) if k not in gone)
    return out


def random_docs(seed, n=60):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 5, 9, 14, 30, 60]))) for _ in range(40)]
    out = []
    for i in range(n):
        lines = [" ".join(f"u{rng.randint(0, 9999)}" for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(len(pool))
            part = pool[a : a + rng.randint(1, 9)]
            at = rng.randint(0, len(lines))
            lines[at:at] = [rng.choice(["", " ", "\t"]) + x for x in part] + [""] * rng.randint(0, 1)
        out.append((i, "\n".join(lines)))
    return out


def test_same_as_a_plain_search(spark):
    for seed, run_words in ((1, 50), (2, 20), (3, 8)):
        docs = random_docs(seed)
        frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
        got = {r["doc_id"]: r["text"] for r in L.deduplicated(frame, run_words=run_words).collect()}
        assert got == expected(docs, run_words)
        assert any(got[i] != t for i, t in docs)


def test_a_short_first_place_does_not_hide_a_longer_run(spark):
    """Document 0 holds only half of what 1 and 2 share."""
    half, rest = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = [(0, half), (1, f"{half}\n{rest}\none"), (2, f"two\n{half}\n{rest}"), (3, f"{rest}\n{half}")]
    got = {r["doc_id"]: r["text"] for r in L.deduplicated(spark.createDataFrame([(i, t, "", 0) for i, t in docs], SCHEMA)).collect()}
    assert got == {0: half, 1: f"{half}\n{rest}\none", 2: "two", 3: f"{rest}\n{half}"}


def test_nulls_repeats_and_empty_tables(spark):
    passage = " ".join(f"p{k}" for k in range(51))
    rows = [(1, passage, "x", 1), (1, passage, "y", 2), (None, passage, None, None), (2, None, "", 0), (3, "", "", 0), (4, f"{passage}\n{passage}", "", 0), (5, "é" * 100_000, "", 0)]
    got = sorted(((r["doc_id"], r["text"], r["removed_words"]) for r in L.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    # The null id comes first of all; rows that repeat id and text are one document.
    assert got == sorted([(None, passage, 0), (1, "", 51), (1, "", 51), (2, "", 0), (3, "", 0), (4, "", 102), (5, "é" * 100_000, 0)], key=repr)
    assert L.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_shuffled_copy_joins_in_proportion(spark):
    """Lines in another order, repeats within a document, and passages that very many documents share."""
    rng = random.Random(9)
    lines = [" ".join(f"s{k}x{j}" for j in range(12)) for k in range(3000)]
    other = lines[:]
    rng.shuffle(other)
    passage = "\n".join(" ".join(f"q{k}x{j}" for j in range(20)) for k in range(4))
    docs = [(0, "\n".join(lines)), (1, "\n".join(other)), (2, "\n".join(lines[5:9] * 30))] + [(3 + i, f"own {i}\n{passage}\nend {i}") for i in range(300)]
    frame = spark.createDataFrame([(i, t, "", 0) for i, t in docs], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in L.deduplicated(frame).collect()}
    assert got[0] == docs[0][1] and got[3] == docs[3][1] and all(got[3 + i] == f"own {i}\nend {i}" for i in range(1, 300))
    wanted = expected([docs[0], docs[2]], 50)
    assert got[2] == wanted[2]
    table = L.line_table(frame)
    found = L.anchors(L.winnowed(table))
    assert L.runs_at(table, found).count() <= 2 * table.count()
