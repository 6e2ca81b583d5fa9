"""String and key functions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Competition names and the keys that they stand for, fixed values; a key stands for itself.
COMPETITIONS = {
    "Premier League": "premier-league", "Ligue 1": "ligue-1", "La Liga": "la-liga", "Bundesliga": "bundesliga", "Serie A": "serie-a",
    "Champions League": "champions-league", "MLS": "mls", "Major League Soccer": "mls",
}


@cache
def plain_forms() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """From the Unicode tables: characters whose compatibility decomposition has one ASCII character in it; those with
    several; and those that canonical decomposition makes one other character once diacritics (U+0300 to U+036F) go."""
    one, several, unmarked = {}, {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        ascii_part = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if ascii_part:
            (one if len(ascii_part) == 1 else several)[c] = ascii_part
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not "\u0300" <= x <= "\u036f")
        if len(bare) == 1 and bare != c:
            unmarked[c] = bare
    return one, several, unmarked


def folded(value: Column) -> Column:
    """Lower case without diacritics, for searching; letters that are no accented form of another stay."""
    unmarked = plain_forms()[2]
    bare = F.translate(value, "".join(unmarked), "".join(unmarked.values()))
    return F.lower(F.regexp_replace(bare, "[\\x{300}-\\x{36F}]", ""))


def ascii_form(value: Column) -> Column:
    """The ASCII characters of the compatibility decomposition; all others go. Values that are ASCII as they are take no
    part in the rest."""
    one, several, _ = plain_forms()
    single = F.translate(value, "".join(one), "".join(one.values()))
    # One literal once folded, so that plans stay small.
    pairs = F.str_to_map(F.lit("\x01".join(f"{c}\x02{text}" for c, text in several.items())), F.lit("\x01"), F.lit("\x02"))
    spelled = F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), "")
    rare = "[" + "".join(several) + "]"
    bare = F.regexp_replace(F.when(single.rlike(rare), spelled).otherwise(single), "[^\\x00-\\x7F]", "")
    return F.when(value.rlike("[^\\x00-\\x7F]"), bare).otherwise(value)


def slugify(value: Column) -> Column:
    """Lower-case ASCII letters and digits with single hyphens; 'unknown' where nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(ascii_form(value)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))


def canonical_id(prefix: str, *parts: Column) -> Column:
    """prefix_slug-slug..., without empty parts, 128 characters at most."""
    slugs = F.array_compact(F.array(*(F.when(F.coalesce(p, F.lit("")) != "", slugify(p)) for p in parts)))
    return F.left(F.concat(F.lit(prefix + "_"), F.array_join(slugs, "-")), F.lit(128))


def natural_key(home: Column, away: Column, kickoff: Column, sport: str = "football") -> Column:
    return F.concat_ws("|", F.lit(sport), slugify(home), slugify(away), F.date_format(kickoff, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def reversed_key(key: Column) -> Column:
    """The key with home and away exchanged; null with fewer than four parts."""
    parts = F.split(key, r"\|", 4)
    return F.when(F.size(parts) == 4, F.concat_ws("|", parts[0], parts[2], parts[1], parts[3]))


def key_parts(key: Column) -> Column:
    """(sport, home, away, kickoff) of a natural key; the kickoff may hold the separator; null with fewer than four parts."""
    parts = F.split(key, r"\|", 4)
    return F.when(F.size(parts) == 4, F.struct(parts[0].alias("sport"), parts[1].alias("home"), parts[2].alias("away"), parts[3].alias("kickoff")))


def competition(name: Column) -> Column:
    """Key of a competition by its display name; any other name as it is."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for item in COMPETITIONS.items() for x in item)), name), name)


def event_id_of(provider_id: Column) -> Column:
    return F.substring_index(provider_id, ":", 1)


def percent(value: Column, digits: int = 1) -> Column:
    """A share as percent with a decimal comma, rounded half to even."""
    return F.concat(F.replace(F.format_string(f"%.{digits}f", F.bround(value * 100, digits)), F.lit("."), F.lit(",")), F.lit(" %"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)


def numbers(text: Column) -> Column:
    """Every number in a text, as written."""
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1))


def market_selection(name: Column, home: Column, away: Column) -> Column:
    """An outcome's name as HOME, AWAY or DRAW; null for any other."""
    return F.when(name == home, "HOME").when(name == away, "AWAY").when(F.lower(name) == "draw", "DRAW")
