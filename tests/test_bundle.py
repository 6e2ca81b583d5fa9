"""Bundle documents whose members have wrong types, are missing, or hold faulty elements."""

import datetime as dt
import json

import pytest

from pitsight.operators import bundle

FIXTURE = {
    "fixture": {"id": 9, "date": "2024-03-01T18:00:00+02:00", "status": {"short": "FT"}, "venue": {"name": ""}},
    "league": {"id": 39, "name": "Ligue Ünö", "country": "Land", "season": 2024},
    "teams": {"home": {"id": 40, "name": "Łódź"}, "away": {"id": "50", "name": "Meridian"}},
    "goals": {"home": 2, "away": None},
}
TEAM = "tm_football-lodz-lge-football-ligue-uno-2024"


def documents(spark, *bodies):
    texts = [(f"r{i}", dt.datetime(2030, 1, 1), b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(texts, "raw_id string, collected_at timestamp_ntz, body string")


def test_a_sound_fixture(spark):
    row = bundle.fixtures(documents(spark, {"response": [FIXTURE]})).first()
    assert row["reason"] is None and row["match_id"] == "mth_football-9" and row["home_team_id"].startswith("tm_football-") and row["venue"] is None
    assert row["kickoff_at"] == dt.datetime(2024, 3, 1, 16) == row["available_at"] and (row["home_score"], row["away_score"]) == (2, None)


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"fixture": 7}, "invalid_payload"), ({"league": None}, "invalid_payload"), ({"fixture": {**FIXTURE["fixture"], "id": ""}}, "missing_provider_id"), ({"fixture": {**FIXTURE["fixture"], "status": {"short": "??"}}}, "unknown_status"),
        ({"fixture": {**FIXTURE["fixture"], "date": "soon"}}, "bad_time"), ({"teams": {"home": {"id": 40, "name": "A"}}}, "missing_participant"), ({"teams": {"home": {"name": "A"}, "away": {"id": 1, "name": "B"}}}, "missing_provider_id"),
        ({"goals": {"home": "two"}}, "invalid_number"), ({"goals": {"home": 1.5}}, "invalid_number"), ({"goals": []}, None),
    ],
)
def test_reasons_of_fixtures(spark, change, reason):
    assert bundle.fixtures(documents(spark, {"response": [FIXTURE | change]})).first()["reason"] == reason


def test_wrong_members_are_named_and_the_rest_is_taken(spark):
    mixed = {"response": [3, FIXTURE | {"events": "none", "lineups": [5, {"team": {"id": 40}, "startXI": [{"player": {"id": 1, "name": "P", "number": 9}}, {"player": {}}, 4]}, {"team": {"id": 41}}], "statistics": [{"team": {"id": 40}}]}], "standings": {}, "injuries": [1, None]}
    raw = documents(spark, mixed, "{broken", None, {"response": None}, [], "7")
    found = {(r["raw_id"], r["entity_type"], r["path"]): r["reason"] for r in bundle.rejected(raw, "L").collect()}
    assert found == {
        ("r0", "fixture", "response[0]"): "invalid_payload", ("r0", "document", "standings"): "invalid_payload", ("r0", "injury", "injuries[0]"): "invalid_payload", ("r0", "injury", "injuries[1]"): "invalid_payload",
        ("r0", "lineup", "response[1].lineups[0]"): "missing_provider_id", ("r0", "lineup", "response[1].lineups[2]"): "missing_provider_id",
        ("r0", "lineup", "response[1].lineups[1].startXI[1]"): "missing_provider_id", ("r0", "lineup", "response[1].lineups[1].startXI[2]"): "missing_provider_id",
        ("r1", "document", "$"): "invalid_json", ("r2", "document", "$"): "invalid_json",
    }
    players = [r for r in bundle.lineups(raw).collect() if r["reason"] is None]
    assert [(r["player_id"], r["jersey_number"]) for r in players] == [("plr_football-p-1", 9)]
    assert bundle.events(raw).count() == 0


def test_teams_are_those_that_the_document_has_named_by_then(spark):
    other = json.loads(json.dumps(FIXTURE))
    other["fixture"]["id"], other["league"]["season"], other["teams"]["home"] = 10, 2025, {"id": 60, "name": "Third"}
    event = lambda team: {"type": "Goal", "time": {"elapsed": 5}, "team": {"id": team}}
    first, second = FIXTURE | {"events": [event(60)]}, other | {"events": [event(50), event(60), event(7)]}
    teams = [r["team_id"] for r in bundle.events(documents(spark, {"response": [first, second]})).orderBy("path").collect()]
    assert teams == [None, "tm_football-meridian-lge-football-ligue-uno-2024", "tm_football-third-lge-football-ligue-uno-2025", None]


def test_places_stay_where_elements_have_other_types(spark):
    figures = {"response": [FIXTURE | {"statistics": [{"team": {"id": 40}, "statistics": [7, None, {"type": "Shots", "value": 3}]}]}]}
    rows = bundle.statistics(documents(spark, figures)).orderBy("path").collect()
    assert [(r["path"][-13:], r["value"], r["reason"]) for r in rows] == [("statistics[0]", None, "invalid_payload"), ("statistics[1]", None, "invalid_payload"), ("statistics[2]", 3, None)]


def test_teams_are_looked_up_not_searched_for_each_element(spark):
    plan = bundle.events(documents(spark, {"response": [FIXTURE]}))._jdf.queryExecution().optimizedPlan().toString()
    assert "named#" in plan and "filter(named#" not in plan


def test_documents_are_built_after_the_shuffles(spark):
    from pitsight.plans import bundles

    plan = bundles._composed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    collected = [line for line in plan.splitlines() if "collect_list" in line]
    assert collected and not any("Player " in line or "4-4-2" in line for line in collected)


def test_documents_lie_in_small_row_groups(spark):
    """A task holds the texts of one row group at once, so their number is bounded whatever the size of the files."""
    import pyarrow.parquet as pq
    from pitsight.plans import bundles

    files = [path.removeprefix("file://") for path in bundles.written(spark, "/root/testdata/sf0.01").inputFiles()]
    metas = [pq.ParquetFile(path).metadata for path in files]
    sizes = [meta.row_group(i).num_rows for meta in metas for i in range(meta.num_row_groups)]
    assert sum(sizes) > 200 and max(sizes) <= 64
