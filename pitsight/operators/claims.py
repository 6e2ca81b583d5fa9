"""Structured claims against facts: cited evidence must exist, be available and fit, and what is claimed must be true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grounding import agrees

#: Kinds of evidence of which each kind of claim must cite one; sides; relations.
EVIDENCE = {
    "team": ("team",), "league": ("league",), "kickoff": ("kickoff",), "model_probability": ("model_probability",), "probability_comparison": ("model_probability",), "model_favorite": ("model_favorite", "model_probability"), "odds": ("odds",),
    "implied_probability": ("implied_probability",), "no_vig_probability": ("no_vig_probability",), "edge": ("edge",), "ev": ("ev",), "value_selection": ("value_selection",), "value_comparison": ("ev", "edge", "value_selection"), "data_mode": ("data_mode",),
    "model_status": ("model_status",),
}
SIDES = ("HOME", "DRAW", "AWAY")
#: In place of a cited field: the id names nothing; it may name a fact of another match.
NOWHERE, ABROAD = "", "?"
#: Kinds of claims whose value, and whose side to compare with, may be numbers.
FIGURES, COMPARED = ("model_probability", "odds", "implied_probability", "no_vig_probability", "edge", "ev"), ("probability_comparison", "value_comparison", "edge", "ev")
HIGH, LOW, LIVE = ("high", "positive"), ("low", "negative"), ("live", "live_market", "true")
#: What a match's context says, and the kind of evidence that each of it is.
FIELDS = {
    "home_team": "team", "away_team": "team", "league": "league", "kickoff": "kickoff", "home_probability": "model_probability", "draw_probability": "model_probability", "away_probability": "model_probability", "model_favorite": "model_favorite",
    "value_selection": "value_selection", "odds": "odds", "implied_probability": "implied_probability", "no_vig_probability": "no_vig_probability", "edge": "edge", "ev": "ev", "data_mode": "data_mode", "model_status": "model_status",
}


def catalogue(contexts: DataFrame) -> DataFrame:
    """(match_id, evidence_id, evidence_type, field, value, availability): every field of a context as one fact, whose
    value is text; one that is null is unavailable."""
    facts = F.array(*(F.struct(F.lit(name).alias("field"), F.lit(kind).alias("evidence_type"), F.col(name).cast("string").alias("value")) for name, kind in FIELDS.items()))
    rows = contexts.select("match_id", F.explode(facts).alias("f")).select("match_id", "f.*")
    return rows.select("match_id", F.concat_ws(":", F.col("match_id").cast("string"), "field").alias("evidence_id"), "evidence_type", "field", "value", F.when(F.col("value").isNull(), "unavailable").otherwise("available").alias("availability"))


def number(raw: Column) -> Column:
    """A number as it is claimed: with point or comma, sign and percent sign; null for anything else."""
    shown = F.translate(F.trim(raw), ",+%", ".")
    # A cast that fails is dear, so words and times aren't tried.
    return F.when(shown.rlike(r"(?i)^[\x00-\x20]*-?(?:[.\d][\da-fxp.-]*|inf(?:inity)?|nan)[\x00-\x20]*$"), shown.try_cast("double"))


def as_share(shown: Column) -> Column:
    """A claimed figure as a share: more than one in size is percent."""
    return F.when(F.abs(shown) > 1, shown / 100).otherwise(shown)


def relation_holds(left: Column, relation: Column, right: Column) -> Column:
    return (
        F.when(relation == "greater_than", left > right).when(relation == "less_than", left < right).when(relation == "equal", left == right)
        .when(relation == "greater_or_equal", left >= right).when(relation == "less_or_equal", left <= right)
    )


def _cited_sums(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """(claim_id, unknown, unavailable, types, fields) of the cited facts of each claim."""
    cited = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id")).join(facts.select("evidence_id", "evidence_type", "field", "availability"), "evidence_id", "left")
    return cited.groupBy("claim_id").agg(
        F.bool_or(F.col("availability").isNull()).alias("unknown"), F.bool_or(F.col("availability") != "available").alias("unavailable"), F.collect_set("evidence_type").alias("types"), F.collect_set("field").alias("fields"),
    )


def _of_others(claims: DataFrame, contexts: DataFrame, ids: Column) -> DataFrame:
    """(claim_id, _unknown, _unavailable, _types, _fields): what each claim's citations of facts of other matches sum up
    to. An id is parted into match and field, so that the contexts' facts needn't become rows of their own."""
    field, key = F.substring_index("evidence_id", ":", -1), contexts.schema["match_id"].dataType
    shown = F.left("evidence_id", F.length("evidence_id") - F.length(field) - 1)
    cited = claims.select("claim_id", F.explode(ids).alias("evidence_id")).select("claim_id", field.alias("field"), shown.alias("shown"), shown.try_cast(key).alias("match_id"))
    # Only an id as it is written in the catalogue names a match.
    cited = cited.withColumn("match_id", F.when(F.col("match_id").cast("string") == F.col("shown"), F.col("match_id")))
    lacking = contexts.select("match_id", _lacking().alias("lacking"))
    kinds = F.create_map(*(F.lit(x) for item in FIELDS.items() for x in item))
    known = F.col("lacking").isNotNull()
    return cited.join(lacking, "match_id", "left").groupBy("claim_id").agg(
        F.bool_or(~known).alias("_unknown"), F.bool_or(known & F.array_contains("lacking", F.col("field"))).alias("_unavailable"),
        F.collect_set(F.when(known, F.try_element_at(kinds, F.col("field")))).alias("_types"), F.collect_set(F.when(known, F.col("field"))).alias("_fields"),
    )


def _lacking() -> Column:
    """The fields of a context that are null."""
    return F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in FIELDS)))


def _cited_in_contexts(claims: DataFrame, contexts: DataFrame) -> DataFrame:
    """Claims with their match's context and what the facts that they cite sum up to. Only claims that cite facts of other
    matches are shuffled by their id, the others stay with their context; an id whose last part is no field names nothing
    anywhere."""
    field_of = lambda e: F.substring_index(e, ":", -1)
    known = lambda e: F.coalesce(field_of(e).isin(*FIELDS), F.lit(False))
    own = lambda e: F.coalesce(e == F.concat("_prefix", field_of(e)), F.lit(False))
    ids = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    # Each id as its field, where it is one of the own match, or as a sign.
    told = F.transform(ids, lambda e: F.when(~known(e), NOWHERE).when(own(e), field_of(e)).otherwise(ABROAD))
    marked = claims.withColumn("_prefix", F.concat(F.col("match_id").cast("string"), F.lit(":"))).withColumn("_told", told)
    abroad = F.array_contains("_told", ABROAD)
    theirs = _of_others(marked.where(abroad), contexts, F.filter(ids, lambda e: known(e) & ~own(e)))
    held = contexts.withColumn("_held", F.lit(True)).hint("shuffle_hash")
    at_home, far = marked.where(~abroad).join(held, "match_id", "left"), marked.where(abroad).join(held, "match_id", "left").join(theirs, "claim_id", "left")
    rows = far.unionByName(at_home, allowMissingColumns=True)
    none = F.array().cast("array<string>")
    named = F.array_remove(F.array_remove("_told", NOWHERE), ABROAD)
    rows = rows.withColumn("_named", named).withColumn("_own", F.when(F.col("_held"), F.array_distinct("_named")).otherwise(none))
    fitting = F.create_map(*(x for kind, types in EVIDENCE.items() for x in (F.lit(kind), F.array(*(F.lit(n) for n, t in FIELDS.items() if t in types)))))
    fits = F.arrays_overlap("_own", F.try_element_at(fitting, F.col("claim_type"))) | F.arrays_overlap(F.coalesce("_types", none), F.try_element_at(_allowed(), F.col("claim_type")))
    return rows.withColumns({
        # Ids of no field, null ids, and those of a match without a context.
        "unknown": F.array_contains("_told", NOWHERE) | F.col("_held").isNull() & (F.size("_named") > 0) | F.coalesce("_unknown", F.lit(False)),
        "unavailable": F.arrays_overlap("_own", _lacking()) | F.coalesce("_unavailable", F.lit(False)), "fits": fits, "fields": F.array_distinct(F.concat("_own", F.coalesce("_fields", none))),
    })


def _allowed() -> Column:
    return F.create_map(*(x for k, v in EVIDENCE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))


def verdicts(claims: DataFrame, contexts: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(claim_id, verdict): supported, or why not.

    claims: (claim_id, match_id, claim_type, subject, value, relation, compare_to, evidence_ids), all but the keys text or
    null. contexts: (match_id, the FIELDS), null where a match has no such fact; evidence: catalogue(contexts), unless
    other availabilities are given. A claim cites any number of facts; they meet it in one join by evidence_id and are
    summed up a claim, with what they lack, before the context joins by match_id."""
    if evidence is None:
        rows = _cited_in_contexts(claims, contexts)
    else:
        rows = claims.join(_cited_sums(claims, evidence), "claim_id", "left").join(contexts, "match_id", "left")
        rows = rows.withColumn("fits", F.arrays_overlap("types", F.try_element_at(_allowed(), F.col("claim_type"))))
    c = F.col
    kind = c("claim_type")

    def side(raw: Column) -> Column:
        shown = F.trim(raw)
        return F.when(F.upper(shown).isin(*SIDES), F.upper(shown)).when(F.lower(shown) == F.lower("home_team"), "HOME").when(F.lower(shown) == F.lower("away_team"), "AWAY")

    named = lambda raw: F.trim(F.coalesce(raw, F.lit(""))) != ""
    p_of = lambda s: F.when(s == "HOME", c("home_probability")).when(s == "DRAW", c("draw_probability")).when(s == "AWAY", c("away_probability"))
    field_of = lambda s: F.concat(F.lower(s), F.lit("_probability"))
    cites = lambda field: F.coalesce(F.array_contains("fields", field), F.lit(False))
    # As columns of their own, which many expressions share.
    rows = rows.withColumns({"_subject": side(c("subject")), "_meant": side(F.coalesce(c("subject"), c("value"))), "_to": side(c("compare_to")), "_n": F.when(kind.isin(*FIGURES), number(c("value"))), "_m": F.when(kind.isin(*COMPARED), number(c("compare_to")))})
    rows = rows.withColumns({"_claimed": as_share(c("_n")), "_target": as_share(c("_m")), "_other": F.when(c("_m").isNull(), c("_to"))})
    rows = rows.withColumns({"_p": p_of(c("_subject")), "_right": F.coalesce(p_of(c("_other")), F.when(c("_target").between(0, 1), c("_target"))), "_share": F.when(c("_claimed").between(0, 1), c("_claimed"))})
    subject, meant, other, right = c("_subject"), c("_meant"), c("_other"), c("_right")
    unknown_subject = named(c("subject")) & subject.isNull()
    no_value = c("value_selection").isNull()
    misattributed = subject.isNotNull() & (subject != c("value_selection"))
    ok = F.lit("supported")

    model = (
        F.when(unknown_subject, "unknown_subject").when(subject.isNull(), "missing_subject").when(~cites(field_of(subject)), "uncited_field").when(c("value").isNull(), "missing_value")
        .when(F.coalesce(agrees(c("_share"), c("_p"), F.lit(False)), F.lit(False)), ok).otherwise("wrong_value")
    )
    comparison = (
        F.when(unknown_subject, "unknown_subject").when(subject.isNull() | c("relation").isNull() | c("compare_to").isNull(), "missing_subject").when(~cites(field_of(subject)) | other.isNotNull() & ~cites(field_of(other)), "uncited_field")
        .when(F.coalesce(relation_holds(c("_p"), c("relation"), right), F.lit(False)), ok).otherwise("false_relation")
    )
    pick = lambda actual: F.when(actual.isNull(), "unavailable_value").when(named(F.coalesce("subject", "value")) & meant.isNull(), "unknown_subject").when(meant.isNull(), "missing_subject").when(meant == actual, ok).otherwise("wrong_selection")
    value_comparison = (
        F.when(no_value, "unavailable_value").when(unknown_subject, "unknown_subject").when(subject.isNull(), "missing_subject").when(misattributed, "wrong_selection").when(c("relation").isNull() | c("compare_to").isNull(), "missing_relation")
        .when(other.isNotNull(), "uncited_field").when(F.coalesce(relation_holds(c("ev"), c("relation"), c("_target")), F.lit(False)), ok).otherwise("false_relation")
    )

    def owned(rest: Column) -> Column:
        return F.when(no_value, "unavailable_value").when(unknown_subject, "unknown_subject").when(misattributed, "wrong_selection").otherwise(rest)

    def metric(actual: Column) -> Column:
        target = F.when(c("compare_to").isNull(), F.lit(0e0)).otherwise(c("_target"))
        word = F.lower(F.trim("value"))
        # Equal as percents to a tenth or as they are to a thousandth.
        equal = agrees(c("_claimed"), actual, F.lit(True)) | agrees(c("_claimed"), actual, F.lit(False))
        by_value = F.when(word.isin(*HIGH), F.when(actual > 0, ok).otherwise("wrong_direction")).when(word.isin(*LOW), F.when(actual < 0, ok).otherwise("wrong_direction")).when(c("value").isNull() | F.coalesce(equal, F.lit(False)), ok).otherwise("wrong_value")
        return owned(F.when(c("relation").isNotNull(), F.when(F.coalesce(relation_holds(actual, c("relation"), target), F.lit(False)), ok).otherwise("false_relation")).otherwise(by_value))

    priced = owned(F.when(c("value").isNull() | (F.bround(c("_n").cast("decimal(20,9)"), 3) == F.bround(c("odds").cast("decimal(20,9)"), 3)), ok).otherwise("wrong_value"))
    market = lambda actual: owned(F.when(c("value").isNull() | F.coalesce(agrees(c("_share"), actual, F.lit(False)), F.lit(False)), ok).otherwise("wrong_value"))
    same = lambda claimed, actual: F.when(F.coalesce(F.lower(claimed) == F.lower(actual), F.lit(False)), ok).otherwise("wrong_value")
    mode = F.lower(F.coalesce("value", "subject", F.lit("")))
    by_type = {
        "model_probability": model, "probability_comparison": comparison, "model_favorite": pick(c("model_favorite")), "value_selection": pick(c("value_selection")), "value_comparison": value_comparison, "ev": metric(c("ev")), "edge": metric(c("edge")),
        "odds": priced, "implied_probability": market(c("implied_probability")), "no_vig_probability": market(c("no_vig_probability")), "data_mode": same(F.when(mode.isin(*LIVE), "live").otherwise(mode), c("data_mode")), "model_status": same(c("value"), c("model_status")),
        "team": F.when(~named(F.coalesce("subject", "value")) | meant.isNotNull(), ok).otherwise("unknown_subject"), "league": same(F.coalesce("value", "subject"), c("league")), "kickoff": same(c("value"), c("kickoff")),
    }
    decided = F.when(~kind.isin(*EVIDENCE), "unsupported_type").when(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0, "missing_evidence").when(c("unknown"), "unknown_evidence").when(c("unavailable"), "unavailable_evidence")
    decided = decided.when(~c("fits"), "wrong_type")
    for name, verdict in by_type.items():
        decided = decided.when(kind == name, verdict)
    return rows.select("claim_id", decided.alias("verdict"))
