"""Claims of every type against one match: forms of numbers, words, names, relations, and what they must cite."""

from pyspark.sql import functions as F

from pitsight.operators import claims

CONTEXT = (1, "Nation 7", "Étoile", "Ligue", "2024-01-02T10:00:00Z", 0.453, 0.3, 0.247, "HOME", "AWAY", 2.5, 0.4, 0.38, -0.031, 0.12, "mock", "candidate")
CONTEXT_SCHEMA = (
    "match_id long, home_team string, away_team string, league string, kickoff string, home_probability double, draw_probability double, away_probability double, model_favorite string, value_selection string, odds double, implied_probability double, "
    "no_vig_probability double, edge double, ev double, data_mode string, model_status string"
)
SCHEMA = "claim_id long, match_id long, claim_type string, subject string, value string, relation string, compare_to string, evidence_ids array<string>"
#: type, subject, value, relation, compare_to, cited fields, verdict.
CASES = [
    ("model_probability", "home", "45,3 %", None, None, ["home_probability"], "supported"), ("model_probability", "Nation 7", "0.4534", None, None, ["home_probability"], "supported"), ("model_probability", "HOME", "45.4", None, None, ["home_probability"], "wrong_value"),
    ("model_probability", "HOME", "4530", None, None, ["home_probability"], "wrong_value"), ("model_probability", "HOME", "many", None, None, ["home_probability"], "wrong_value"), ("model_probability", "HOME", None, None, None, ["home_probability"], "missing_value"),
    ("model_probability", "HOME", "0.453", None, None, ["draw_probability"], "uncited_field"), ("model_probability", None, "0.453", None, None, ["home_probability"], "missing_subject"), ("model_probability", "Nobody", "0.453", None, None, ["home_probability"], "unknown_subject"),
    ("probability_comparison", "HOME", None, "greater_than", "DRAW", ["home_probability", "draw_probability"], "supported"), ("probability_comparison", "HOME", None, "greater_than", "DRAW", ["home_probability"], "uncited_field"),
    ("probability_comparison", "HOME", None, "less_than", "50%", ["home_probability"], "supported"), ("probability_comparison", "HOME", None, "less_or_equal", "0.4", ["home_probability"], "false_relation"), ("probability_comparison", "HOME", None, None, "0.4", ["home_probability"], "missing_subject"),
    ("model_favorite", "home", None, None, None, ["model_favorite"], "supported"), ("model_favorite", None, "étoile", None, None, ["home_probability"], "wrong_selection"), ("value_selection", None, "away", None, None, ["value_selection"], "supported"), ("value_selection", "Nobody", None, None, None, ["value_selection"], "unknown_subject"),
    ("value_comparison", "AWAY", None, "greater_than", "10", ["ev"], "supported"), ("value_comparison", "AWAY", None, "greater_than", "HOME", ["ev"], "uncited_field"), ("value_comparison", "HOME", None, "greater_than", "0", ["edge"], "wrong_selection"), ("value_comparison", "AWAY", None, None, "0", ["ev"], "missing_relation"),
    ("ev", None, "+12%", None, None, ["ev"], "supported"), ("ev", None, "0.1204", None, None, ["ev"], "supported"), ("ev", "home", "0.12", None, None, ["ev"], "wrong_selection"), ("ev", None, "Positive", None, None, ["ev"], "supported"), ("ev", None, "low", None, None, ["ev"], "wrong_direction"), ("ev", None, None, None, None, ["ev"], "supported"),
    ("edge", None, "-3.1", None, None, ["edge"], "supported"), ("edge", None, None, "less_than", None, ["edge"], "supported"), ("edge", None, None, "equal", "0.031", ["edge"], "false_relation"), ("odds", None, "2.500", None, None, ["odds"], "supported"), ("odds", None, "2.51", None, None, ["odds"], "wrong_value"),
    ("implied_probability", "AWAY", "40%", None, None, ["implied_probability"], "supported"), ("no_vig_probability", "AWAY", "0.39", None, None, ["no_vig_probability"], "wrong_value"), ("data_mode", "MOCK", None, None, None, ["data_mode"], "supported"), ("data_mode", None, "true", None, None, ["data_mode"], "wrong_value"),
    ("model_status", None, "Candidate", None, None, ["model_status"], "supported"), ("team", "DRAW", None, None, None, ["home_team"], "supported"), ("team", None, "Nobody", None, None, ["home_team"], "unknown_subject"), ("league", "LIGUE", None, None, None, ["league"], "supported"), ("kickoff", None, "2024-01-02T10:00:00Z", None, None, ["kickoff"], "supported"),
    ("injury", None, None, None, None, ["ev"], "unsupported_type"), ("ev", None, "0.12", None, None, [], "missing_evidence"), ("ev", None, "0.12", None, None, None, "missing_evidence"), ("ev", None, "0.12", None, None, ["ev", "nothing"], "unknown_evidence"), ("ev", None, "0.12", None, None, ["odds"], "wrong_type"),
]


def judged(spark, cases, context):
    rows = [(i, 1, t, s, v, r, o, None if f is None else [f"1:{x}" for x in f]) for i, (t, s, v, r, o, f, *_) in enumerate(cases)]
    found = claims.verdicts(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([context], CONTEXT_SCHEMA)).collect()
    return {r["claim_id"]: r["verdict"] for r in found}


def test_claims_of_every_type(spark):
    found = judged(spark, CASES, CONTEXT)
    assert [(CASES[i][:5], found[i], CASES[i][6]) for i in found if found[i] != CASES[i][6]] == [] and len(found) == len(CASES)


def test_matches_without_value(spark):
    bare = (*CONTEXT[:9], *([None] * 6), *CONTEXT[15:])
    cases = [("ev", None, "0.12", None, None, ["ev"]), ("value_selection", "home", None, None, None, ["value_selection"]), ("model_probability", "home", "0.453", None, None, ["home_probability"]), ("value_comparison", "AWAY", None, "less_than", "1", ["value_selection"])]
    assert judged(spark, cases, bare) == {0: "unavailable_evidence", 1: "unavailable_evidence", 2: "supported", 3: "unavailable_evidence"}


def test_citations_of_other_matches_agree_with_the_join_of_all(spark):
    bare = (2, *CONTEXT[1:9], *([None] * 6), *CONTEXT[15:])
    held = spark.createDataFrame([CONTEXT, bare], CONTEXT_SCHEMA)
    cited = [["1:ev"], ["2:ev"], ["1:ev", "2:league"], ["2:ev", "1:ev"], ["1:ev", "9:ev"], ["1:ev:x"], ["ev"], ["1:ev", None], ["2:league"], None, []]
    made = spark.createDataFrame([(i * 10 + m, m, "ev", None, "0.12", None, None, ids) for i, ids in enumerate(cited) for m in (1, 2, 3)], SCHEMA)
    of = lambda rows: {r["claim_id"]: r["verdict"] for r in rows.collect()}
    assert of(claims.verdicts(made, held)) == of(claims.verdicts(made, held, claims.catalogue(held)))


def test_claims_of_own_facts_are_not_shuffled_again(spark):
    held = spark.createDataFrame([CONTEXT], CONTEXT_SCHEMA)
    made = spark.createDataFrame([(1, 1, "ev", None, "0.12", None, None, ["1:ev"])], SCHEMA)
    plan = claims.verdicts(made, held)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in plan


def test_only_claims_that_cite_other_matches_join_by_their_id(spark):
    held = spark.createDataFrame([CONTEXT], CONTEXT_SCHEMA)
    made = spark.createDataFrame([(1, 1, "ev", None, "0.12", None, None, ["1:ev"]), (2, 1, "ev", None, "0.12", None, None, ["2:ev"])], SCHEMA)
    plan = claims.verdicts(made, held)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Union":
        plan = plan.children().head()
    joins = [plan.children().apply(i).toString().count("Join ") for i in range(plan.children().size())]
    assert joins == [3, 1]


def test_citations_that_are_written_otherwise_name_nothing(spark):
    held = spark.createDataFrame([CONTEXT], CONTEXT_SCHEMA)
    cited = [["01:ev"], [" 1:ev"], ["1.0:ev"], ["+1:ev"], [":ev"], ["1::ev"], ["x:ev", "1:ev"], ["1:ev", "1:ev"]]
    made = spark.createDataFrame([(i * 10 + m, m, "ev", None, "0.12", None, None, ids) for i, ids in enumerate(cited) for m in (1, 2)], SCHEMA)
    of = lambda rows: {r["claim_id"]: r["verdict"] for r in rows.collect()}
    assert of(claims.verdicts(made, held)) == of(claims.verdicts(made, held, claims.catalogue(held)))


def test_words_are_no_numbers(spark):
    shown = ["45,3 %", "+1e3", "-.5", "7.", "NaN", "-Infinity", "0x1p3", "1d", "Nation 7", "2024-01-02T10:00:00Z", "HOME", "-", "", "1.2.3", "1 2", None]
    rows = spark.createDataFrame([(s,) for s in shown], "s string").select("s", claims.number(F.col("s")).cast("string").alias("n")).collect()
    assert [r["n"] for r in rows] == ["45.3", "1000.0", "-0.5", "7.0", "NaN", "-Infinity", "8.0", "1.0", *[None] * 8]
