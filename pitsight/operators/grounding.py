"""Checks of claims and prose against computed facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of evidence that each kind of claim may cite: fixed values.
ALLOWED = {
    "model_probability": ("probability",), "probability_comparison": ("probability",), "model_favorite": ("probability",), "expected_value": ("ev",), "edge": ("edge",),
    "odds": ("odds",), "market_probability": ("implied", "no_vig"), "value_comparison": ("ev", "edge"),
}
SIGNED = ("expected_value", "edge")
BLOCKED_TERMS = ("guaranteed", "risk-free", "sure bet", "can't lose", "certain win")


def evidence_rows(values: DataFrame) -> DataFrame:
    """(match_id, evidence_id, selection, kind, value): every figure of the value rows as one fact."""
    kinds = {"probability": "p", "implied": "implied", "no_vig": "no_vig", "odds": "odds", "edge": "edge", "ev": "ev"}
    facts = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items())))
    flat = values.select("match_id", "selection", facts.alias("f")).select("match_id", "selection", "f.*")
    return flat.withColumn("evidence_id", F.concat_ws(":", F.col("match_id").cast("string"), "selection", "kind"))


def agrees(claimed: Column, actual: Column, signed: Column) -> Column:
    """Equal after rounding: percents to a tenth, signed values to a thousandth; claims of more than one in size are percents."""
    as_share = F.when(F.abs(claimed) > 1, claimed / 100e0).otherwise(claimed)
    return F.when(signed, F.bround(as_share, 3) == F.bround(actual, 3)).otherwise(F.bround(as_share * 100, 1) == F.bround(actual * 100, 1))


def holds(left: Column, relation: Column, right: Column) -> Column:
    return (
        F.when(relation == "gt", left > right).when(relation == "lt", left < right).when(relation == "eq", F.abs(left - right) < 1e-9)
        .when(relation == "ge", left >= right).when(relation == "le", left <= right)
    )


def check_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, verdict): supported, missing_evidence, wrong_type or wrong_value.

    claims: (claim_id, claim_type, evidence_id, claimed)."""
    joined = claims.join(evidence.select("evidence_id", "kind", "value"), "evidence_id", "left")
    allowed = F.create_map(*(x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    typed = F.array_contains(F.try_element_at(allowed, F.col("claim_type")), F.col("kind"))
    right = F.when(F.col("claim_type") == "odds", F.abs(F.col("claimed") - F.col("value")) < 1e-9).otherwise(agrees(F.col("claimed"), F.col("value"), F.col("claim_type").isin(*SIGNED)))
    verdict = F.when(F.col("kind").isNull(), "missing_evidence").when(~F.coalesce(typed, F.lit(False)), "wrong_type").when(right, "supported").otherwise("wrong_value")
    return joined.select("claim_id", verdict.alias("verdict"))


def ungrounded_numbers(texts: DataFrame, key: str, text: str, allowed: DataFrame) -> DataFrame:
    """(key, number): numbers in a text that aren't among its allowed ones. allowed: (key, number), or (number) for all."""
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)))).alias("number"))
    on = [key, "number"] if key in allowed.columns else ["number"]
    return found.join(allowed.select(*on).distinct(), on, "left_anti").select(key, "number")


def first_blocked(text: Column, terms: tuple[str, ...] = BLOCKED_TERMS) -> Column:
    """The first of the blocked terms that a text holds, in the terms' order; null without any."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t)), F.lit(1))


def confidence(model_status: Column, data_mode: Column, identity_complete: Column, value_available: Column) -> Column:
    full = identity_complete & value_available
    return F.when((model_status == "champion") & (data_mode == "live") & full, "high").when((model_status == "candidate") & full, "medium").otherwise("low")
