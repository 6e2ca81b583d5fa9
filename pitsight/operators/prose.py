"""Prose against facts: every number, name, date and statement in a text must be among what its context allows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns that statements in prose are read with.
NAME_TOKEN = r"(?:St\.\s+)?[A-Z][A-Za-zÀ-ÿ']+"
PATTERNS = {
    "percent": r"(\d+(?:[.,]\d+)?)\s*(?:%|％|percent\b)",
    "odds": r"(?:odds|cote|priced at|price of|prix de)\s*(?:=|de|:)?\s*(\d+(?:[.,]\d+)?)",
    "ev": r"(?:\bev\b|espérance(?: théorique)?)\s*(?:=|de|:)?\s*([+-]?\d+(?:[.,]\d+)?)",
    "edge": r"\bedge\b\s*(?:=|de|:)?\s*([+-]?\d+(?:[.,]\d+)?)",
    "points": r"([+-]\d+(?:[.,]\d+)?)\s*points",
    "team_token": r"(\bTeam\s+[A-Z0-9]+\b)",
    "iso_date": r"(\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)?)",
    "proper_name": rf"\b({NAME_TOKEN}(?:\s+(?:d'|de |del |l'|la |le )?{NAME_TOKEN})+)\b",
    "acronym": r"\b([A-Z]{2,5})\b",
    "title_token": r"\b([A-Z][a-zÀ-ÿ]{4,})\b",
    "number": r"(?<![\w.-])([+-]?\d+(?:[.,]\d+)?)(?![\w.])",
    "model_probability": (
        r"model(?:ed|led)?(?:\s+at)?(?:\s+probability)?|the model gives|model gives|probabilit[ée]s? (?:modèle|modélisée|modeled)|highest (?:model )?probability|"
        r"plus haute probabilit[ée]|probabilit[ée] supérieure|modèle (?:estime|donne|attribue)"
    ),
    "highest_probability": r"highest (?:model )?probability|plus haute probabilit[ée](?: modèle)?|la plus haute probabilit[ée]|most likely|le plus probable",
    "best_value": r"best value|meilleure valeur|meilleure value|the value pick|best bet",
    "live_affirmation": r"live markets?|live odds|cotes live|données live|uses live|using live|marchés? live|real[- ]time (?:market|odds)|données en direct|(?<!pas )en direct",
    "live_negation": r"pas (?:être )?présenté(?:es)? comme live|not (?:be )?presented as live|ne (?:doit|peuvent|peut) pas[^.]*live|not live|pas live",
}
#: Those of them in which case counts.
CASED = ("team_token", "iso_date", "proper_name", "acronym", "title_token", "number")
#: What a text in small ASCII letters holds at least, if one of these patterns is in it.
SIGNS = {
    "percent": ("%", "percent"), "odds": ("odds", "cote", "price", "prix"), "ev": ("ev",), "edge": ("edge",), "points": ("points",), "highest_probability": ("highest", "plus haute", "most likely", "plus probable"),
    "best_value": ("best", "meilleure", "value pick"), "live_affirmation": ("live", "real", "en direct"),
}
#: Names and words that name nobody, and terms that no text may hold.
NARRATIVE_NAMES = ("value engine",)
ACRONYMS = ("HOME", "AWAY", "DRAW", "EV", "PIT", "AI", "HTTP", "JSON", "DTO", "ID", "UTC")
FUNCTION_WORDS = tuple(
    "the this that these those there their then when with from elles elle ils eux nous vous ceci cela ceux cette cet ces model value engine selection favorite issue match league probability expected analysis analyst "
    "status version candidate champion implied theoretical available complete identity payload source sources fait faits valeurs données modèle probabilité implicite espérance théorique statut disponible identit "
    "incertitude texte reste interprétatif estimations statistiques résultat futur confiance limitée métadonnées suivantes aucune cote cotes analyse équipe domicile extérieur écart combine présenté présentes contexte "
    "validé structurelle complète servi candidat production marquées stale partial explicitement indisponibles complétées attribu modélisée brute marché calculée par n'est".split()
)
FORBIDDEN = (
    "garanti", "guarantee", "sûr", "sure win", "safe bet", "certain", "100%", "blessure", "blessé", "injury", "injured", "hurt", "composition", "lineup", "line-up", "mise", "pari recommandé", "should be played",
    "must be played", "gain", "ce pari va gagner", "pari sûr", "gain garanti", "expected goals", "possession", "tirs cadrés", "shots on target", "score final", "a gagné le match", "won the match", "final score",
    "classement", "ranking", "standings",
)
INVENTED_TOPICS = (
    "xg", "expected goals", "possession", "tirs cadrés", "shots on target", "blessure", "blessé", "injury", "injured", "hurt", "composition", "lineup", "line-up", "score final", "a gagné le match", "won the match",
    "final score", "classement", "ranking", "standings", "trois derniers matchs", "last three matches", "dernier résultat", "last result", "probable lineup", "composition probable",
)
FAVOURITE_MARKERS = ("favori du modèle", "favorite du modèle", "model favorite", "favori modèle", "issue favorite")
FAVOURITE_NEGATIONS = ("n'est pas", "n’est pas", "pas le favori", "not the model favorite")
PROMOTIONS, PROMOTION_NEGATION = ("modèle champion", "champion model", "modèle est un champion"), "pas un champion"
UNAVAILABLE_VALUE, UNAVAILABLE_NEGATIONS = ("edge", "espérance", "implicite brute"), ("aucune", "n'est affirmée")
SELECTION_WORDS = {"HOME": r"\bhome\b|\bdomicile\b", "AWAY": r"\baway\b|\bextérieur\b|\bvisitor\b|\bvisiteur\b", "DRAW": r"\bdraw\b|\bmatch nul\b"}
NUMBERS = "array<decimal(20,6)>"


class NameAutomaton:
    """Finds names in a text whatever their case: the leftmost first, of those that begin there the longest, none
    overlapping another. Trie with failure links; every character is passed once, and again only within a name that
    turns out not to go on."""

    def __init__(self, names: tuple[str, ...]):
        self.next: list[dict[str, int]] = [{}]
        self.depth, self.found, self.fail = [0], [0], [0]
        for name in names:
            node = 0
            for c in map(_low, name):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.found.append(0)
                    self.fail.append(0)
                node = self.next[node][c]
            # Length of the longest name that ends here.
            self.found[node] = self.depth[node]
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                queue.append(child)
                back = self.fail[node]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(c, 0)
                self.found[child] = self.found[child] or self.found[self.fail[child]]

    def spans(self, text: str) -> list[tuple[int, int]]:
        out, node, start, end, i = [], 0, -1, -1, 0
        while i < len(text) or start >= 0:
            if i < len(text):
                c = _low(text[i])
                while node and c not in self.next[node]:
                    node = self.fail[node]
                node = self.next[node].get(c, 0)
                i += 1
            # A name is settled once nothing that begins at it, or before, can still go on.
            if start >= 0 and (i - self.depth[node] > start or i == len(text) and not self._ends(node, i, start)):
                out.append((start, end))
                node, i, start = 0, end, -1
                continue
            if self.found[node] and (start < 0 or i - self.found[node] <= start):
                start, end = i - self.found[node], i
            if i == len(text) and start >= 0:
                out.append((start, end))
                node, i, start = 0, end, -1
                if end == len(text):
                    break
        return out

    def _ends(self, node: int, i: int, start: int) -> bool:
        return bool(self.found[node]) and i - self.found[node] <= start


def _low(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


@lru_cache(maxsize=4096)
def automaton(names: tuple[str, ...]) -> NameAutomaton:
    return NameAutomaton(names)


def name_spans(text: Column, names: Column) -> Column:
    """Array of (start, end) of the names in a text, in characters from 0; each row has its own names, equal lists share
    an automaton. Null texts and lists have none."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def found(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in automaton(tuple(sorted({n for n in some if n}))).spans(text)] if text and some is not None else [] for text, some in zip(texts, lists)])

    return found(text, names)


def corpus_name_spans(texts: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """(key, start, end): the names in each text, by one automaton for all of them, built once in each task. The list
    goes to every task, so it has to be a bounded one."""
    listed = tuple(sorted({n for n in names if n}))

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = NameAutomaton(listed)
        for frame in frames:
            rows = [(k, a, b) for k, value in zip(frame[key], frame[text]) if value for a, b in one.spans(value)]
            yield pd.DataFrame(rows, columns=[key, "start", "end"])

    return texts.select(key, text).mapInPandas(found, f"`{key}` {texts.schema[key].dataType.simpleString()}, start int, end int")


def masked(text: Column, spans: Column) -> Column:
    """The text with a blank in place of each span."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text)))
    parts = F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a))
    return F.when(text.isNotNull(), F.array_join(parts, " "))


def pattern(name: str) -> str:
    """A pattern with Unicode classes; case only counts where it is one of those."""
    return ("(?U)" if name in CASED else "(?iuU)") + PATTERNS[name]


def all_of(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern(name)), F.lit(1))


def holds(text: Column, name: str) -> Column:
    return text.rlike(pattern(name))


def decimals(found: Column) -> Column:
    """Numbers as they are written, with point or comma."""
    return F.transform(found, lambda x: F.translate(x, ",+", ".").try_cast("decimal(20,6)"))


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(text, F.lit(term))
    return out


def first_term(text: Column, terms: tuple[str, ...]) -> Column:
    """The first of the terms that a text holds: whole words, but terms with a blank or percent sign anywhere."""
    return first_of_low(F.lower(text), terms)


def first_of_low(low: Column, terms: tuple[str, ...]) -> Column:
    def held(term: str) -> Column:
        # Most texts lack most terms, which the plain search finds out at once.
        anywhere = F.contains(low, F.lit(term.lower()))
        return anywhere if " " in term or "%" in term else anywhere & low.rlike(rf"(?U)\b\Q{term.lower()}\E\b")

    return F.coalesce(*(F.when(held(t), t) for t in terms))


def context(values: DataFrame) -> DataFrame:
    """What a match's prose may say, from its three value rows (match_id, selection, odds, p, implied, no_vig, edge, ev):
    allowed percents, model percents, odds, signed figures and numbers, the favourite and the selection with the most
    value. chosen says which row the prose is about."""
    share = lambda c: F.bround(F.col(c).cast("decimal(20,12)") * 100, 1).cast("decimal(20,6)")
    thousandth = lambda c: F.bround(F.col(c).cast("decimal(20,12)"), 3).cast("decimal(20,6)")
    own = lambda *parts: F.flatten(F.collect_list(F.when(F.col("chosen"), F.array(*parts))))
    return values.groupBy("match_id").agg(
        F.collect_list(share("p")).alias("model_percents"), own(share("implied"), share("no_vig"), F.abs(share("edge")), F.abs(share("ev"))).alias("value_percents"), own(thousandth("odds")).alias("allowed_odds"),
        own(share("edge"), thousandth("edge"), share("ev"), thousandth("ev")).alias("signed"), F.collect_list(thousandth("p")).alias("model_numbers"), own(thousandth("odds"), thousandth("implied"), thousandth("no_vig")).alias("value_numbers"),
        F.max_by("selection", F.struct("p", "selection")).alias("favourite"), F.max(F.when(F.col("chosen"), F.col("selection"))).alias("value_selection"),
    )


def findings(texts: DataFrame, key: str = "match_id") -> DataFrame:
    """(key, rule, token): all that a text says and its context doesn't allow; no row for a grounded text.

    texts: key, text, home_team, away_team, league, literals (other names that may stand in it), days, the columns of
    `context`, model_status, data_mode. A null value_selection says that no value is known. Names and dates are masked
    before numbers are read. Every rule is an expression over the row; nothing is shuffled."""
    c = F.col
    names = F.array_compact(F.concat(F.array("home_team", "away_team", "league"), F.coalesce("literals", F.array().cast("array<string>"))))
    undated = F.regexp_replace("text", pattern("iso_date"), " ")
    rows = texts.withColumn("names", names).withColumn("_u", undated).withColumn("_s", name_spans(c("_u"), F.concat("names", F.array(F.lit("1X2")))))
    spaced = lambda x: F.concat(F.lit(" "), F.regexp_replace(F.lower(x), r"(?U)\W+", " "), F.lit(" "))
    rows = rows.withColumn("scanned", masked(c("_u"), c("_s"))).withColumn("spaced_names", F.transform("names", spaced)).drop("_u", "_s")
    none = F.array().cast("array<string>")
    no_value = c("value_selection").isNull()
    rows = rows.withColumns({"_low": F.lower("scanned"), "_ascii": F.char_length("scanned") == F.octet_length("scanned")})
    # The plain search finds out at once that most texts lack most patterns; beyond ASCII, letters have more than two cases.
    may_hold = lambda name: contains_any(c("_low"), SIGNS[name]) | ~c("_ascii")
    figures = lambda *names: F.concat(*(F.when(may_hold(n), decimals(all_of(c("scanned"), n))).when(c("scanned").isNotNull(), F.array().cast(NUMBERS)) for n in names))
    told = lambda name: may_hold(name) & holds(c("scanned"), name)
    # Columns of their own, each computed once a row: a lambda would compute what it refers to for every element.
    rows = rows.withColumns({
        "sentences": F.filter(F.split(F.trim("scanned"), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != ""), "_percents": figures("percent"), "_allowed": F.array_compact(F.concat("model_percents", "value_percents")),
        "_named": F.transform(F.concat(*(all_of(c("text"), p) for p in ("proper_name", "acronym", "title_token"))), lambda n: F.struct(n.alias("n"), F.lower(n).alias("low"), spaced(n).alias("spaced"))),
    })
    allowed_numbers = F.concat("_allowed", "model_numbers", "value_numbers", "signed", F.transform("days", lambda d: F.left(d, F.lit(4)).cast("decimal(20,6)")), F.array(F.lit(1), F.lit(2)).cast(NUMBERS))
    shown = lambda numbers: F.transform(numbers, lambda x: x.cast("string"))
    # A figure that is no number stays.
    beyond = lambda found, allowed: shown(F.array_except(found, F.array_compact(allowed)))
    # Percents of the value rows that aren't the model's.
    rows = rows.withColumn("_foreign", F.array_except(F.array_intersect("_percents", "_allowed"), "model_percents"))

    def mentioned(sentence: Column) -> Column:
        sides = [F.when(F.lower(sentence).rlike("(?U)" + words), F.lit(s)) for s, words in SELECTION_WORDS.items()]
        return F.array_compact(F.array(*sides))

    def wrong_model_percents(sentence: Column) -> Column:
        return F.when(holds(sentence, "model_probability"), shown(F.array_intersect(decimals(all_of(sentence, "percent")), c("_foreign")))).otherwise(none)

    def sentences_where(condition, some: Column) -> Column:
        """The sentences of a condition, if the text, in which sentences are, holds what it takes."""
        return F.when(some, F.filter("sentences", condition)).otherwise(none)

    when = lambda condition, token: F.when(condition, F.array(token)).otherwise(none)
    others = lambda s, pick: F.exists(mentioned(s), lambda x: ~x.eqNullSafe(pick))
    confused = lambda s: holds(s, "highest_probability") & others(s, c("favourite"))
    not_best = lambda s: holds(s, "best_value") & (no_value | others(s, c("value_selection")))
    promoted_value = lambda s: (
        ~no_value & (c("value_selection") != c("favourite")) & contains_any(F.lower(s), FAVOURITE_MARKERS) & ~contains_any(F.lower(s), FAVOURITE_NEGATIONS)
        & F.array_contains(mentioned(s), c("value_selection")) & ~F.array_contains(mentioned(s), c("favourite"))
    )
    live = lambda s: (c("data_mode") == "mock") & holds(s, "live_affirmation") & ~holds(s, "live_negation")
    low = c("_low")
    known = lambda n: (
        n["low"].isin(*NARRATIVE_NAMES, *FUNCTION_WORDS) | n["n"].isin(*ACRONYMS) | F.left(n["n"], F.lit(2)).isin("L'", "D'", "N'", "C'") | F.exists("spaced_names", lambda a: F.contains(a, n["spaced"]))
    )
    rules = {
        "forbidden_term": F.array_compact(F.array(first_of_low(low, FORBIDDEN))),
        "invented_topic": F.array_compact(F.array(first_of_low(low, INVENTED_TOPICS))),
        "favourite_confused": sentences_where(confused, told("highest_probability")),
        "best_value_confused": sentences_where(not_best, told("best_value")),
        "value_as_favourite": sentences_where(promoted_value, contains_any(low, FAVOURITE_MARKERS)),
        "candidate_promoted": when((c("model_status") == "candidate") & contains_any(low, PROMOTIONS) & ~F.contains(low, F.lit(PROMOTION_NEGATION)), c("model_status")),
        "mock_as_live": sentences_where(live, told("live_affirmation")),
        "percent": beyond(c("_percents"), c("_allowed")),
        "model_percent": F.when(F.size("_foreign") > 0, F.flatten(F.transform("sentences", wrong_model_percents))).otherwise(none),
        "value_unavailable": when(no_value & (told("odds") | contains_any(low, UNAVAILABLE_VALUE) & ~contains_any(low, UNAVAILABLE_NEGATIONS)), F.lit("value")),
        "odds": F.when(~no_value, beyond(figures("odds"), c("allowed_odds"))),
        "signed": F.when(~no_value, beyond(figures("ev", "edge", "points"), c("signed"))),
        "number": beyond(decimals(all_of(c("scanned"), "number")), allowed_numbers),
        "team_token": F.when(F.contains("text", F.lit("Team")), F.filter(all_of(c("text"), "team_token"), lambda t: ~F.exists("names", lambda a: F.lower(a) == F.lower(t)))),
        "name": F.transform(F.filter("_named", lambda n: ~known(n)), lambda n: n["n"]),
        "date": F.when(F.contains("text", F.lit("-")), F.filter(all_of(c("text"), "iso_date"), lambda d: ~F.array_contains("days", F.left(d, F.lit(10))))),
    }
    rows = rows.withColumns({f"_{rule}": tokens for rule, tokens in rules.items()})
    nothing = F.array().cast("array<struct<rule:string,token:string>>")
    listed = F.flatten(F.array(*(F.when(F.size(f"_{rule}") > 0, F.transform(F.array_distinct(f"_{rule}"), _tagged(rule))).otherwise(nothing) for rule in rules)))
    # Computed before they are exploded, as a generator's own input isn't compiled; outer, as else it would be computed
    # a second time to leave out rows without findings.
    return rows.withColumn("_found", listed).select(key, F.explode_outer("_found").alias("x")).where("x IS NOT NULL").select(key, "x.rule", "x.token")


def _tagged(rule: str):
    return lambda token: F.struct(F.lit(rule).alias("rule"), token.alias("token"))
