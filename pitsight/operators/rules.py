"""Ordered rules as data: the first and all reasons that a row fails by, and those that fail a whole load."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A row fails where the condition is true (null is not true); a fatal rule that any row fails by stops the load."""

    name: str
    condition: Column
    fatal: bool = False


class RefusedLoad(ValueError):
    """A load that a fatal rule, or the lack of any row that passes, has stopped."""


def first_reason(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that a row fails by; null if it passes. One chain of conditions, the later ones only
    looked at where the earlier ones hold."""
    chain = F.when(F.lit(False), "")
    for rule in rules:
        chain = chain.when(rule.condition, rule.name)
    return chain


def all_reasons(rules: Sequence[Rule]) -> Column:
    """The names of all rules that a row fails by, in their order."""
    return F.array_compact(F.array(*(F.when(rule.condition, rule.name) for rule in rules)).cast("array<string>"))


def checked(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows with reason and reasons; a row that fails first by a fatal rule raises an error in the job that reads it."""
    out = rows.withColumns({"reason": first_reason(rules), "reasons": all_reasons(rules)})
    fatal = [rule.name for rule in rules if rule.fatal]
    if not fatal:
        return out
    stopped = F.raise_error(F.concat(F.lit("refused by "), F.col("reason"))).cast("string")
    return out.withColumn("reason", F.when(F.col("reason").isin(fatal), stopped).otherwise(F.col("reason")))


def triage(rows: DataFrame, rules: Sequence[Rule], passing: str = "eligible") -> DataFrame:
    """(reason, n) by first reasons, passing rows under the given name. One pass, with partial counts."""
    return rows.groupBy(F.coalesce(first_reason(rules), F.lit(passing)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def accepted(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that pass all rules. Refuses the load before any is handed on: where a fatal rule is failed by, and where
    no row passes; the counts of all reasons are in the error."""
    found = {r["reason"]: r["n"] for r in triage(rows, rules).collect()}
    broken = [rule.name for rule in rules if rule.fatal and found.get(rule.name)]
    if broken or not found.get("eligible"):
        raise RefusedLoad(f"{'failed ' + ', '.join(broken) if broken else 'no eligible rows'}: {dict(sorted(found.items()))}")
    return rows.where(first_reason(rules).isNull())


def prematch_rules(live_only: bool = True) -> list[Rule]:
    """What keeps a match (data_mode, home_team_id, away_team_id, status, home_score, away_score) from features before
    kickoff."""
    live = [Rule("data_mode_mock", F.col("data_mode") != "live")] if live_only else []
    return [
        *live, Rule("missing_home_team", F.coalesce(F.col("home_team_id").cast("string"), F.lit("")) == ""), Rule("missing_away_team", F.coalesce(F.col("away_team_id").cast("string"), F.lit("")) == ""),
        Rule("not_scheduled", ~F.col("status").eqNullSafe(F.lit("scheduled"))), Rule("scheduled_has_score", F.col("home_score").isNotNull() | F.col("away_score").isNotNull()),
    ]


def prematch_rejections(rows: DataFrame, wanted: DataFrame | None = None, live_only: bool = True) -> DataFrame:
    """(match_id, reason) of the rejected matches that are reported: scheduled ones and, if ids (match_id) are wanted,
    those among them; others are left out without a word."""
    judged = rows.withColumn("reason", first_reason(prematch_rules(live_only))).where(F.col("reason").isNotNull())
    if wanted is not None:
        return judged.join(wanted.select("match_id").distinct(), "match_id", "left_semi").select("match_id", "reason")
    return judged.where(F.col("status") == "scheduled").select("match_id", "reason")


def odds_rules(source: str, complete: Column) -> list[Rule]:
    """What keeps a snapshot (data_mode, source, in_universe, available_at, cutoff_at, kickoff_at) from a backtest. Mock
    odds and those of another source stop the load."""
    return [
        Rule("mock_odds", (F.col("data_mode") == "mock") | F.col("source").startswith("mock"), fatal=True), Rule("non_live_data_mode", ~F.col("data_mode").eqNullSafe(F.lit("live"))), Rule("unexpected_provider", ~F.col("source").eqNullSafe(F.lit(source)), fatal=True),
        Rule("outside_oos_universe", ~F.coalesce(F.col("in_universe"), F.lit(False))), Rule("incomplete_1x2", ~complete), Rule("available_at_after_cutoff", F.col("available_at") > F.col("cutoff_at")), Rule("post_kickoff", F.col("available_at") > F.col("kickoff_at")),
    ]
