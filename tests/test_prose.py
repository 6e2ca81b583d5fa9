"""Prose against facts: the automaton against plain search, every pattern, every rule and its negation."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitsight.operators import prose


def by_hand(names, text):
    low, i, out = "".join(map(prose._low, text)), 0, []
    while i < len(text):
        best = max((len(n) for n in names if n and low.startswith("".join(map(prose._low, n)), i)), default=0)
        out += [(i, i + best)] if best else []
        i += best or 1
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("abBé", max_size=5), max_size=6), st.text("abAÉé", max_size=20))
def test_spans_are_leftmost_and_longest(names, text):
    assert prose.NameAutomaton(tuple(names)).spans(text) == by_hand(names, text)


def test_time_is_linear_in_the_text():
    automaton = prose.NameAutomaton(("a" * 40 + "b", "ab"))
    assert automaton.spans("a" * 200_000 + "b") == [(200_000 - 40, 200_001)]


def test_spans_and_masks(spark):
    rows = spark.createDataFrame([("Inter 2 beat Inter", ["Inter", "Inter 2"]), ("x", []), (None, ["a"]), ("é1é", ["É"]), ("all", ["ALL"])], "text string, names array<string>")
    spans = rows.withColumn("s", prose.name_spans(F.col("text"), F.col("names"))).withColumn("m", prose.masked(F.col("text"), F.col("s")))
    assert [[tuple(s) for s in r["s"]] for r in spans.collect()] == [[(0, 7), (13, 18)], [], [], [(0, 1), (2, 3)], [(0, 3)]]
    assert [r["m"] for r in spans.collect()] == ["  beat  ", "x", None, " 1 ", " "]
    found = prose.corpus_name_spans(rows.withColumn("key", F.monotonically_increasing_id()), "key", "text", ["inter", "1"])
    assert sorted((r["start"], r["end"]) for r in found.collect()) == [(0, 5), (1, 2), (13, 18)]


SAMPLES = {
    "percent": ("45,3 % and 7percent, 8 percentage", ["45,3", "7"]), "odds": ("Odds 2.10; cote: 3,5; priced at 4", ["2.10", "3,5", "4"]), "ev": ("EV +0.12, espérance théorique de -1,5, never 3", ["+0.12", "-1,5"]), "edge": ("Edge = 3.2 knowledge 4", ["3.2"]),
    "points": ("+3.5 points, 4 points", ["+3.5"]), "team_token": ("Team B2 and Team c", ["Team B2"]), "iso_date": ("2024-01-02T10:00:00Z, 2024-13", ["2024-01-02T10:00:00Z"]), "proper_name": ("St. Pauli Nord met Real de Madrid today", ["St. Pauli Nord", "Real de Madrid"]),
    "acronym": ("the PSG and A", ["PSG"]), "title_token": ("Lille Élan Zürich", ["Lille", "Zürich"]), "number": ("1 v2 3.4 5-6 é7 8é +9, 1,2,3.", ["1", "3.4", "5", "+9", "1,2"]),
}


def test_every_pattern_that_takes_something_out(spark):
    rows = spark.createDataFrame([tuple(s[0] for s in SAMPLES.values())], ", ".join(f"{n} string" for n in SAMPLES))
    found = rows.select(*(prose.all_of(F.col(n), n).alias(n) for n in SAMPLES)).first()
    assert found.asDict() == {n: s[1] for n, s in SAMPLES.items()}
    assert len(prose.PATTERNS) == 16


def text_row(text, value_selection="HOME", favourite="AWAY", mode="mock", status="candidate"):
    d = Decimal
    known = value_selection is not None
    return (1, text, "Nation 7", "Étoile d'Or", "Ligue Une", ["engine-2"], ["2024-01-02"], [d("45.3"), d("30"), d("24.7")], [d("50"), d("2.5")] if known else [], [d("2")] if known else [], [d("-3.1"), d("-0.031")] if known else [], [d("0.453")], [d("0.5")] if known else [], favourite, value_selection, status, mode)


SCHEMA = (
    "match_id long, text string, home_team string, away_team string, league string, literals array<string>, days array<string>, model_percents array<decimal(20,6)>, value_percents array<decimal(20,6)>, allowed_odds array<decimal(20,6)>, "
    "signed array<decimal(20,6)>, model_numbers array<decimal(20,6)>, value_numbers array<decimal(20,6)>, favourite string, value_selection string, model_status string, data_mode string"
)
CASES = [
    ("Nation 7 meet Étoile d'Or in 2024, on 2024-01-02. 1X2 by engine-2.", {}, set()),
    ("The model gives 45,3%.", {}, set()), ("The model gives 50%.", {}, {"model_percent"}), ("Implied 50% only.", {}, set()), ("It is 51%.", {}, {"percent", "number"}),
    ("Odds 2.000 with edge -3.1 and EV -0.031 now.", {}, set()), ("Odds 2.01 here", {}, {"odds", "number"}), ("EV +0.031 here", {}, {"signed", "number"}), ("-3.1 points here", {}, set()), ("odds 2 here", {"value_selection": None}, {"value_unavailable"}),
    ("aucune edge affirmée", {"value_selection": None}, set()), ("the edge is thin", {"value_selection": None}, {"value_unavailable"}), ("best value is unknown", {"value_selection": None}, {"best_value_confused"}),
    ("Best value is home.", {}, set()), ("Best value is the visitor.", {}, {"best_value_confused"}), ("Most likely is away.", {}, set()), ("Le plus probable: match nul.", {}, {"favourite_confused"}), ("Most likely is home. Away wins.", {}, {"favourite_confused"}),
    ("The home side is the model favorite.", {}, {"value_as_favourite"}), ("The home side is not the model favorite.", {}, set()), ("The home side is the model favorite.", {"favourite": "HOME"}, set()),
    ("A champion model.", {}, {"candidate_promoted"}), ("A champion model, pas un champion.", {}, set()), ("A champion model.", {"status": "champion"}, set()),
    ("It uses live odds.", {}, {"mock_as_live"}), ("It uses live odds, not live.", {}, set()), ("It uses live odds.", {"mode": "live"}, set()), ("Pas en direct.", {}, set()), ("En direct.", {}, {"mock_as_live"}),
    ("A certain win and uncertainty.", {}, {"forbidden_term"}), ("uncertain again", {}, set()), ("XG rises", {}, {"invented_topic", "name"}), ("no expected goals", {}, {"forbidden_term", "invented_topic"}),
    ("Real Madrid play", {}, {"name"}), ("UNESCO says", {}, set()), ("PSG says", {}, {"name"}), ("L'Équipe says", {}, set()), ("Team B2 says", {}, {"team_token"}), ("on 2024-01-03", {}, {"date"}), ("number 7 here", {}, {"number"}), ("Nation 7 is 1 of 2 here", {}, set()), ("", {}, set()), (None, {}, set()),
]


def test_rules_and_their_negations(spark):
    rows = spark.createDataFrame([(i, *text_row(text, **more)[1:]) for i, (text, more, _) in enumerate(CASES)], SCHEMA)
    found = {i: set() for i in range(len(CASES))}
    for r in prose.findings(rows).collect():
        found[r["match_id"]].add(r["rule"])
    wrong = [(CASES[i][0], found[i], CASES[i][2]) for i in found if found[i] != CASES[i][2]]
    assert wrong == []


def test_longer_terms_are_found_anywhere(spark):
    row = spark.createDataFrame([("une garantie de 100%",)], "t string").select(prose.first_term(F.col("t"), prose.FORBIDDEN).alias("x")).first()
    assert row["x"] == "100%"


@pytest.mark.parametrize("terms", [prose.FORBIDDEN, prose.INVENTED_TOPICS])
def test_every_term_is_found(spark, terms):
    rows = spark.createDataFrame([(t,) for t in terms], "t string")
    assert rows.where(prose.first_term(F.concat(F.lit("Ceci: "), F.upper("t"), F.lit("!")), terms).isNull()).count() == 0


def test_planted_figures_are_never_true(spark):
    from pitsight.plans.grounding import without_planted

    rows = spark.createDataFrame([(1, [Decimal("137.5"), Decimal("99.5")]), (2, [Decimal("137.5"), Decimal("99.5")]), (14, [Decimal("137.5")]), (4, [Decimal("137.5"), None])], "match_id long, signed array<decimal(20,6)>")
    found = {r["match_id"]: r["signed"] for r in without_planted(rows, F.col("match_id") % 13).collect()}
    assert found == {1: [Decimal("99.5")], 2: [Decimal("137.5")], 14: [], 4: [Decimal("137.5"), None]}


def test_rules_are_computed_before_rows_are_exploded(spark):
    """A generator's own input isn't compiled; and no filter computes the findings a second time."""
    rows = spark.createDataFrame([(0, *text_row("It is 51%.")[1:])], SCHEMA)
    plan = prose.findings(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(_found" in plan and plan.count("AS _forbidden_term#") == 1


def test_letters_beyond_ascii_are_read_by_the_patterns(spark):
    """Patterns know more cases of a letter than the plain search: the long s, and the Kelvin sign."""
    texts = ["Moſt liKely is draw.", "Oddſ 2.01 here", "uſes liVe oddſ", "Beſt value is the visitor.", "12,5 ％ more", "Eſpérance 0.9"]
    rows = spark.createDataFrame([(i, *text_row(t)[1:]) for i, t in enumerate(texts)], SCHEMA)
    found = {i: set() for i in range(len(texts))}
    for r in prose.findings(rows).collect():
        found[r["match_id"]].add(r["rule"])
    wanted = ["favourite_confused", "odds", "mock_as_live", "best_value_confused", "percent"]
    assert [w in found[i] for i, w in enumerate(wanted)] == [True] * 5
