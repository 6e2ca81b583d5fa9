"""Rule chains, point lookups, canonical assembly."""

import pytest
from pyspark.sql import functions as F

from pitsight.operators import canonical, rules
from pitsight.operators.rules import RefusedLoad, Rule
from pitsight.sources import lookup


def test_first_and_all_reasons(spark):
    rows = spark.createDataFrame([(1, 5), (2, -5), (3, None), (4, 50)], "id long, x int")
    chain = [Rule("missing", F.col("x").isNull()), Rule("negative", F.col("x") < 0), Rule("odd", F.col("x") % 2 != 0)]
    assert {r["id"]: (r["reason"], r["reasons"]) for r in rules.checked(rows, chain).collect()} == {1: ("odd", ["odd"]), 2: ("negative", ["negative", "odd"]), 3: ("missing", ["missing"]), 4: (None, [])}
    assert {r["reason"]: r["n"] for r in rules.triage(rows, chain).collect()} == {"odd": 1, "negative": 1, "missing": 1, "eligible": 1}
    assert [r["id"] for r in rules.accepted(rows, chain).collect()] == [4]
    assert [r["reason"] for r in rules.checked(rows, []).collect()] == [None] * 4


def test_fatal_rules_stop_a_load(spark):
    rows = spark.createDataFrame([(1, "live"), (2, "mock")], "id long, mode string")
    fatal = [Rule("mock", F.col("mode") == "mock", fatal=True)]
    with pytest.raises(Exception, match="refused by mock"):
        rules.checked(rows, fatal).select("reason").collect()
    assert rules.checked(rows.where("id = 1"), fatal).count() == 1
    with pytest.raises(RefusedLoad, match="failed mock"):
        rules.accepted(rows, fatal)
    with pytest.raises(RefusedLoad, match="no eligible rows"):
        rules.accepted(rows, [Rule("all", F.lit(True))])


def test_reported_rejections(spark):
    rows = spark.createDataFrame([(1, "live", "a", "", "scheduled", None, None), (2, "mock", "a", "b", "finished", 1, 1), (3, "live", "a", "b", "scheduled", None, 0), (4, "live", "a", "b", "scheduled", None, None)], "match_id long, data_mode string, home_team_id string, away_team_id string, status string, home_score int, away_score int")
    assert sorted(map(tuple, rules.prematch_rejections(rows).collect())) == [(1, "missing_away_team"), (3, "scheduled_has_score")]
    wanted = spark.createDataFrame([(2,), (4,)], "match_id long")
    assert list(map(tuple, rules.prematch_rejections(rows, wanted).collect())) == [(2, "data_mode_mock")]
    assert list(map(tuple, rules.prematch_rejections(rows, wanted, live_only=False).collect())) == [(2, "not_scheduled")]


def test_lookups_pass_row_groups_by(spark, tmp_path):
    path = f"{tmp_path}/store"
    # Even ids only: an odd one lies within the bounds of a row group, and only its filter tells that it isn't there.
    rows = spark.range(200_000).select((F.col("id") * 2).alias("match_id"), F.sha2(F.col("id").cast("string"), 256).alias("x"), F.when(F.col("id") % 2 == 0, 1).alias("home_win"))
    lookup.write_store(rows, path, files=4, group_bytes=1 << 18)
    ids = [7000 * i for i in range(10)]
    some = lookup.lookup(spark, path, [*ids, ids[0], None])
    assert sorted(r["match_id"] for r in some.collect()) == ids
    assert "Or(EqualTo(match_id" in some._jdf.queryExecution().toString().replace("Or(Or(", "Or(").replace("Or(Or(", "Or(")
    assert lookup.scanned_rows(lookup.lookup(spark, path, ids)) < 60_000
    assert lookup.scanned_rows(lookup.lookup(spark, path, [70_001, 70_003])) < 20_000
    assert lookup.lookup(spark, path, []).count() == 0
    assert sorted(r["match_id"] for r in lookup.labelled(spark, path, [0, 2, 4, 6], ("home_win",)).collect()) == [0, 4]
    assert lookup.lookup_all(spark, path, spark.createDataFrame([(4,), (4,), (5,)], "match_id long")).count() == 1
    assert lookup.lookup_all(spark, path, spark.createDataFrame([], "match_id long")).count() == 0


def test_canonical_assembly(spark):
    matches = spark.createDataFrame([(1, 1, 10, 20), (2, 9, 10, 99)], "match_id long, league_id long, home_team_id long, away_team_id long")
    snapshots = spark.createDataFrame([(5, 1, "b", 2), (6, 1, "a", 1), (7, 1, "c", 0), (8, 77, "d", 0)], "snapshot_id long, match_id long, bookmaker string, available_at long")
    selections = spark.createDataFrame([(5, "HOME", 2.0), (5, "AWAY", None), (6, "DRAW", 3.0), (8, "HOME", 9.0), (404, "HOME", 9.0)], "snapshot_id long, selection string, decimal_odds double")
    leagues, sports = spark.createDataFrame([(1, 3, "L")], "league_id long, sport_id long, name string"), spark.createDataFrame([(3, "football")], "sport_id long, code string")
    teams = spark.createDataFrame([(10, "Ten"), (20, "Twenty")], "team_id long, team_name string")
    rows = {r["match_id"]: r for r in canonical.canonical(sports, leagues, teams, matches, snapshots, selections).collect()}
    assert [(s["snapshot_id"], [tuple(x) for x in s["selections"]]) for s in rows[1]["snapshots"]] == [(6, [("DRAW", 3.0)]), (5, [("AWAY", None), ("HOME", 2.0)])]
    assert (rows[1]["sport"], rows[1]["league"], rows[1]["away_team"]) == ("football", "L", "Twenty")
    assert rows[2]["snapshots"] == [] and rows[2]["league"] is None and rows[2]["away_team"] is None
    plan = canonical.nested(matches, snapshots, selections)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning(match_id") <= 2
