"""Teams in arrival order: outcomes that the order changes, against a plain fold over all rows; components of the keys."""

import random

from pitsight.operators import resolution

SCHEMA = "seq long, provider string, provider_id string, own_id string, name_key string, aliased boolean, franchise string, own_franchise string"


def resolved(spark, rows, ambiguous=()):
    names = spark.createDataFrame([(n,) for n in ambiguous], "name_key string")
    return {r["seq"]: (r["canonical_id"], r["method"]) for r in resolution.resolved_in_order(spark.createDataFrame(rows, SCHEMA).repartition(3), names).collect()}


def plain(rows, ambiguous=()):
    state, out = resolution.Bindings(), {}
    for seq, provider, provider_id, own_id, name, aliased, franchise, own in sorted(rows):
        out[seq] = state.resolve((provider, provider_id), own_id, name, aliased, franchise, own, name in ambiguous)[:2]
    return out


def test_order_changes_the_outcome(spark):
    first, second, third = (1, "a", "1", "t1", "n", False, None, "f"), (2, "a", "2", "t2", "n", False, None, "f"), (3, "b", "1", "t3", "m", True, "f", "g")
    assert resolved(spark, [first, second, third]) == {1: ("t1", "exact_id"), 2: ("t1", "normalized_name"), 3: ("t1", "historical_alias")}
    moved = [(3, *first[1:]), (2, *second[1:]), (1, *third[1:])]
    assert resolved(spark, moved) == {1: ("t3", "exact_id"), 2: ("t2", "exact_id"), 3: ("t2", "normalized_name")}


def test_ambiguous_names_are_resolved_only_by_ids(spark):
    rows = [(1, "a", "1", "t1", "n", False, None, "f"), (2, "a", "1", "t1", "m", False, None, "f"), (3, "a", "1", "t1", "n", False, None, "f"), (4, "b", "9", "t9", "n", True, "f", "f")]
    assert resolved(spark, rows, ["n"]) == {1: (None, "ambiguous"), 2: ("t1", "exact_id"), 3: ("t1", "provider_id"), 4: ("t1", "historical_alias")}
    assert resolved(spark, []) == {}


def test_random_rows_equal_one_fold_over_all(spark):
    r = random.Random(4)
    rows = [(i, r.choice("ab"), f"i{r.randrange(60)}", f"t{i}", f"n{r.randrange(70)}", r.random() < 0.2, r.choice([None, None, f"f{r.randrange(50)}"]), f"f{r.randrange(50)}") for i in range(250)]
    found = resolved(spark, rows, ["n3", "n4"])
    assert found == plain(rows, ["n3", "n4"]) and {m for _, m in found.values()} == set(resolution.DETAILS)


def test_components_of_a_long_chain_and_of_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(20, 40)] + [(5, 5)]
    labels = dict(map(tuple, resolution.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert set(labels.values()) == {100, 7, 5} and all(labels[i] == 100 for i in range(100, 161)) and labels[5] == 5
