"""A provider's bundle documents: fixtures with their events, lineups and statistics, standings and injuries in one JSON text.

Every output reads the texts once: they are parsed to variants, of which only what it needs is taken out, arrays are
exploded with their places, and each element becomes a row with its path and the reason why it isn't taken (null if it is). Values of other types than expected are
nulls with a reason and never fail a document; only an element that can't be taken is left out, with what it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .fixtures import lenient_time
from .intake import SHORT_CODES, status_of

SPORT = "football"
#: States of an injury; what a lineup's lists mean.
INJURY_STATES = ("injured", "doubtful", "suspended", "returned", "unknown")
ROLES = {"startXI": "starter", "substitutes": "bench"}
#: What is read of an element of `response`, and of the lists below it: values as they are shown, null where the document
#: has another type.
TEAM_SHAPE, PLAYER_SHAPE = "struct<id:string,name:string>", "struct<id:string,name:string,number:string,pos:string>"
FIXTURE_SHAPE = {
    "fixture": "struct<id:string,date:string,status:struct<short:string>,venue:struct<name:string>>", "league": "struct<id:string,name:string,country:string,season:string>",
    "teams": f"struct<home:{TEAM_SHAPE},away:{TEAM_SHAPE}>", "goals": "struct<home:string,away:string>",
}
CHILD_SHAPES = {
    "events": "team:struct<id:string>,time:struct<elapsed:string>,player:struct<id:string,name:string>,type:string,detail:string",
    "lineups": f"team:struct<id:string>,formation:string,startXI:array<struct<player:{PLAYER_SHAPE}>>,substitutes:array<struct<player:{PLAYER_SHAPE}>>",
    "statistics": "team:struct<id:string>,statistics:array<struct<type:string,value:string>>",
}
#: A lineup is known this long before kickoff.
LINEUP_LEAD = "INTERVAL 60 MINUTES"


def get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def whole(text: Column) -> Column:
    """A whole number; null for anything else."""
    return F.when(text.rlike(r"^-?\d{1,18}$"), text.try_cast("long"))


def not_whole(text: Column) -> Column:
    """Whether there is a value that is no whole number."""
    return text.isNotNull() & ~text.rlike(r"^-?\d{1,18}$")


def provider_id(value: Column, path: str) -> Column:
    return F.nullif(get(value, path), F.lit(""))


def entity(prefix: str, *parts: Column) -> Column:
    return X.canonical_id(prefix, F.lit(SPORT), *parts)


def below(prefix: str, name: Column, parent: Column) -> Column:
    """Canonical id of something within another, whose id is a slug already but for the sign after its prefix."""
    return F.left(F.concat_ws("-", F.lit(f"{prefix}_{SPORT}"), X.slugify(name), F.replace(parent, F.lit("_"), F.lit("-"))), F.lit(128))


def listed(value: Column, path: str) -> Column:
    return get(value, path, "array<variant>")


def documents(raw: DataFrame) -> DataFrame:
    """(raw_id, collected_at, doc): the texts parsed; doc is null where one is no JSON."""
    return raw.select("raw_id", "collected_at", F.try_parse_json("body").alias("doc"))


def shown(value: Column) -> Column:
    """A text; null for an empty one."""
    return F.nullif(value, F.lit(""))


def _fixture_elements(raw: DataFrame, *children: str) -> DataFrame:
    """One row an element of `response` with the named lists below it, all taken out of the document at once, and with
    the teams of the document: for each provider's id the first that has a name, and the place where it is named."""
    shape = ",".join(f"{n}:{t}" for n, t in (FIXTURE_SHAPE | {n: f"array<struct<{CHILD_SHAPES[n]}>>" for n in children}).items())
    docs = documents(raw).select("raw_id", "collected_at", get(F.col("doc"), "response", f"array<struct<{shape}>>").alias("response"))
    side = lambda v, i, s: F.struct(shown(v["teams"][s]["id"]).alias("provider_id"), i.alias("pos"), v["teams"][s]["name"].alias("name"), v["league"]["name"].alias("league"), v["league"]["season"].alias("season"))
    sides = F.flatten(F.transform("response", lambda v, i: F.array(side(v, i, "home"), side(v, i, "away"))))
    known = F.filter(sides, lambda t: t["name"].isNotNull() & t["provider_id"].isNotNull())
    # Ordered by id and place, the first of an id is the one that another id comes before.
    ordered = F.array_sort(F.transform(known, lambda t, i: F.struct(t["provider_id"].alias("provider_id"), i.alias("i"), t["pos"].alias("pos"), t["name"].alias("name"), t["league"].alias("league"), t["season"].alias("season"))))
    first = F.filter("ordered", lambda t, i: (i == 0) | (F.try_element_at("ordered", i)["provider_id"] != t["provider_id"]))
    named = F.map_from_entries(F.transform(first, lambda t: F.struct(t["provider_id"], F.struct(t["pos"], t["name"], t["league"], t["season"]))))
    if not children:
        return docs.select("raw_id", "collected_at", F.posexplode("response").alias("pos", "v"))
    teams = docs.withColumn("ordered", ordered).select("raw_id", "collected_at", "response", named.alias("named"))
    return teams.select("raw_id", "collected_at", "named", F.posexplode("response").alias("pos", "v"))


def _fixture_columns(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    paths = {
        "provider_id": "fixture.id", "date": "fixture.date", "short": "fixture.status.short", "ground": "fixture.venue.name", "l_id": "league.id", "l_name": "league.name", "l_country": "league.country", "season": "league.season",
        "h_id": "teams.home.id", "h_name": "teams.home.name", "a_id": "teams.away.id", "a_name": "teams.away.name", "h_goals": "goals.home", "a_goals": "goals.away",
    }
    whole_parts = v["fixture"].isNotNull() & v["league"].isNotNull()
    values = rows.select("*", *(shown(F.col(f"v.{path}")).alias(name) for name, path in paths.items()), whole_parts.alias("sound"))
    c = F.col
    ids = values.withColumns({"league_id": entity("lge", c("l_name"), c("season")), "kickoff_at": lenient_time(c("date")), "status": status_of(c("short"), SHORT_CODES), "home_slug": X.slugify(c("h_name")), "away_slug": X.slugify(c("a_name"))})
    reason = (
        F.when(~c("sound"), "invalid_payload").when(c("provider_id").isNull() | c("l_id").isNull(), "missing_provider_id").when(c("status").isNull(), "unknown_status").when(c("kickoff_at").isNull(), "bad_time")
        .when(c("l_name").isNull() | c("l_country").isNull(), "invalid_payload").when(c("h_name").isNull() | c("a_name").isNull(), "missing_participant").when(c("h_id").isNull() | c("a_id").isNull(), "missing_provider_id")
        .when(not_whole(c("h_goals")) | not_whole(c("a_goals")), "invalid_number")
    )
    # As `below`, with slugs that are there.
    team = lambda slug: F.left(F.concat_ws("-", F.lit(f"tm_{SPORT}"), slug, F.replace("league_id", F.lit("_"), F.lit("-"))), F.lit(128))
    return ids.select(
        "raw_id", F.format_string("response[%d]", "pos").alias("path"), entity("mth", c("provider_id")).alias("match_id"), "provider_id", "kickoff_at", "status", "league_id", "season",
        team(c("home_slug")).alias("home_team_id"), team(c("away_slug")).alias("away_team_id"), whole(c("h_goals")).alias("home_score"), whole(c("a_goals")).alias("away_score"), c("ground").alias("venue"),
        F.concat_ws("|", F.lit(SPORT), "home_slug", "away_slug", F.date_format("kickoff_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("natural_key"),
        # A finished match was known from its kickoff on, any other from when it was collected.
        F.when(c("status") == "finished", c("kickoff_at")).otherwise(c("collected_at")).alias("available_at"), reason.alias("reason"), *(x for x in ("v", "named", "pos") if x in rows.columns),
    )


def fixtures(raw: DataFrame) -> DataFrame:
    """(raw_id, path, match_id, provider_id, kickoff_at, status, league_id, season, teams, scores, venue, natural_key,
    available_at, reason): one row an element of `response`. raw: (raw_id, collected_at, body)."""
    return _fixture_columns(_fixture_elements(raw)).drop("v", "pos")


def _children(raw: DataFrame, name: str) -> DataFrame:
    """Elements of a list below the fixtures, with the fixture's columns and the first named team with the provider's id
    that they point at (null without one). Those of a fixture that isn't taken have the reason rejected_parent."""
    rows = _fixture_columns(_fixture_elements(raw, name)).withColumnRenamed("pos", "at")
    parent = F.when(F.col("reason").isNotNull(), "rejected_parent")
    exploded = rows.select("raw_id", F.col("path").alias("parent"), "match_id", "provider_id", "kickoff_at", "season", parent.alias("parent_reason"), "named", "at", F.posexplode(f"v.{name}").alias("pos", "e"))
    placed = exploded.withColumns({"team": F.try_element_at("named", shown(F.col("e.team.id"))), "path": F.concat("parent", F.format_string(f".{name}[%d]", "pos"))})
    placed = placed.withColumn("team", F.when(F.col("team.pos") <= F.col("at"), F.col("team"))).withColumn("team_league", entity("lge", F.col("team.league"), F.col("team.season")))
    return placed.withColumn("team_id", F.when(F.col("team").isNotNull(), below("tm", F.col("team.name"), F.col("team_league")))).drop("named", "at", "parent", "pos", "team", "team_league")


def events(raw: DataFrame) -> DataFrame:
    """(raw_id, path, event_id, match_id, event_type, label, minute, team_id, player_id, available_at, reason): one row an
    event of a fixture. A team that the document hasn't named and a missing player are null."""
    e = F.col("e")
    player = shown(e["player"]["id"])
    key = F.concat_ws(":", "provider_id", F.coalesce(e["time"]["elapsed"], F.lit("none")), F.coalesce(player, F.lit("none")))
    reason = F.coalesce("parent_reason", F.when(e["type"].isNull(), "invalid_payload").when(not_whole(e["time"]["elapsed"]), "invalid_number"))
    return _children(raw, "events").select(
        "raw_id", "path", entity("evt", key).alias("event_id"), "match_id", X.slugify(e["type"]).alias("event_type"), F.coalesce(shown(e["detail"]), e["type"]).alias("label"),
        whole(e["time"]["elapsed"]).alias("minute"), "team_id", F.when(player.isNotNull(), entity("plr", e["player"]["name"], player)).alias("player_id"), F.col("kickoff_at").alias("available_at"), reason.alias("reason"),
    )


def lineups(raw: DataFrame) -> DataFrame:
    """(raw_id, path, lineup_id, match_id, team_id, formation, player_id, role, jersey_number, position, available_at,
    reason): one row a player of a lineup, or one without a player for a lineup that names none or can't be taken."""
    e = F.col("e")

    def of_role(name: str, role: str) -> Column:
        return F.transform(e[name], lambda p, i: F.struct(F.format_string(f".{name}[%d]", i).alias("at"), F.lit(role).alias("role"), p.alias("p")))

    lists = [of_role(*item) for item in ROLES.items()]
    empty = F.array().cast(f"array<struct<at:string,role:string,p:struct<player:{PLAYER_SHAPE}>>>")
    people = F.concat(*(F.coalesce(x, empty) for x in lists))
    lineup_reason = F.coalesce("parent_reason", F.when(F.col("team_id").isNull(), "missing_provider_id"))
    rows = _children(raw, "lineups").withColumn("lineup_reason", lineup_reason)
    each = rows.select("*", F.explode_outer(F.when(F.col("lineup_reason").isNull(), people)).alias("x"))
    p = F.col("x.p")
    player = shown(p["player"]["id"])
    reason = F.coalesce("lineup_reason", F.when(F.col("x").isNotNull(), F.when(player.isNull(), "missing_provider_id").when(not_whole(p["player"]["number"]), "invalid_number")))
    return each.select(
        "raw_id", F.concat("path", F.coalesce("x.at", F.lit(""))).alias("path"), F.left(F.concat(F.lit("lnp_"), F.replace("match_id", F.lit("_"), F.lit("-")), F.lit("-"), F.replace("team_id", F.lit("_"), F.lit("-"))), F.lit(128)).alias("lineup_id"), "match_id", "team_id", shown(e["formation"]).alias("formation"),
        F.when(player.isNotNull(), entity("plr", p["player"]["name"], player)).alias("player_id"), F.col("x.role").alias("role"), whole(p["player"]["number"]).alias("jersey_number"), shown(p["player"]["pos"]).alias("position"),
        (F.col("kickoff_at") - F.expr(LINEUP_LEAD)).alias("available_at"), reason.alias("reason"),
    )


def statistics(raw: DataFrame) -> DataFrame:
    """(raw_id, path, match_id, team_id, season, stat_key, label, availability, value, as_of, reason): one row a figure of
    a team, unavailable where it has no value; one without a figure for a block whose team isn't known."""
    e = F.col("e")
    block_reason = F.coalesce("parent_reason", F.when(F.col("team_id").isNull(), "missing_provider_id"))
    rows = _children(raw, "statistics").withColumn("block_reason", block_reason)
    each = rows.select("*", F.posexplode_outer(F.when(F.col("block_reason").isNull(), e["statistics"])).alias("at", "s"))
    s = F.col("s")
    figure = s["value"]
    value = figure.try_cast("decimal(18,6)")
    reason = F.coalesce("block_reason", F.when(s["type"].isNull(), "invalid_payload").when(figure.isNotNull() & value.isNull(), "invalid_number"))
    return each.where(F.col("at").isNotNull() | F.col("block_reason").isNotNull()).select(
        "raw_id", F.concat("path", F.when(F.col("at").isNotNull(), F.format_string(".statistics[%d]", "at")).otherwise("")).alias("path"), "match_id", "team_id", "season", X.slugify(s["type"]).alias("stat_key"), s["type"].alias("label"),
        F.when(value.isNotNull(), "available").otherwise("unavailable").alias("availability"), value.alias("value"), F.col("kickoff_at").alias("as_of"), reason.alias("reason"),
    )


#: Figures of a standings row: the provider's names and ours.
TABLE_FIELDS = {"rank": "rank", "points": "points", "played": "played", "win": "won", "draw": "drawn", "lose": "lost", "goals_for": "goals_for", "goals_against": "goals_against"}


def standings(raw: DataFrame, league: str) -> DataFrame:
    """(raw_id, path, league_id, season, team_id, as_of, rank, points, ..., reason): one row a line of a table. The
    documents don't name the league of their tables, so it is given."""
    docs = documents(raw).select("raw_id", F.posexplode(listed(F.col("doc"), "standings")).alias("pos", "t"))
    t = F.col("t")
    head = docs.select("raw_id", get(t, "season").alias("season"), lenient_time(get(t, "as_of")).alias("as_of"), "pos", F.posexplode(listed(t, "table")).alias("at", "r"))
    r = F.col("r")
    head = head.withColumn("league_id", entity("lge", F.lit(league), F.col("season")))
    league_id = F.col("league_id")
    some_bad = None
    for name in TABLE_FIELDS:
        some_bad = not_whole(get(r, name)) if some_bad is None else some_bad | not_whole(get(r, name))
    reason = (
        F.when(F.col("season").isNull(), "invalid_payload").when(F.col("as_of").isNull(), "bad_time").when(get(r, "team.name").isNull(), "missing_participant")
        .when(provider_id(r, "team.id").isNull(), "missing_provider_id").when(some_bad, "invalid_number")
    )
    return head.select(
        "raw_id", F.format_string("standings[%d].table[%d]", "pos", "at").alias("path"), "league_id", "season", below("tm", get(r, "team.name"), league_id).alias("team_id"), "as_of",
        *(whole(get(r, theirs)).alias(ours) for theirs, ours in TABLE_FIELDS.items()), reason.alias("reason"),
    )


def injuries(raw: DataFrame) -> DataFrame:
    """(raw_id, path, injury_id, player_id, team_provider_id, status, description, available_at, reason)."""
    docs = documents(raw).select("raw_id", F.posexplode(listed(F.col("doc"), "injuries")).alias("pos", "i"))
    i = F.col("i")
    status, observed = F.coalesce(get(i, "status"), F.lit("unknown")), lenient_time(get(i, "observed_at"))
    reason = (
        F.when(get(i, "player", "map<string,variant>").isNull() | get(i, "team", "map<string,variant>").isNull(), "invalid_payload").when(observed.isNull(), "bad_time")
        .when(~status.isin(*INJURY_STATES), "unknown_status").when(provider_id(i, "id").isNull() | provider_id(i, "player.id").isNull(), "missing_provider_id")
    )
    return docs.select(
        "raw_id", F.format_string("injuries[%d]", "pos").alias("path"), X.canonical_id("inj", provider_id(i, "id")).alias("injury_id"), entity("plr", get(i, "player.name"), provider_id(i, "player.id")).alias("player_id"),
        provider_id(i, "team.id").alias("team_provider_id"), status.alias("status"), F.nullif(get(i, "type"), F.lit("")).alias("description"), observed.alias("available_at"), reason.alias("reason"),
    )


def rejected(raw: DataFrame, league: str) -> DataFrame:
    """(raw_id, entity_type, path, reason): every element that isn't taken, texts that are no JSON, and members that
    should be lists and aren't; the paths say where they are in the document."""
    docs = documents(raw)
    broken = docs.where(F.col("doc").isNull()).select("raw_id", F.lit("document").alias("entity_type"), F.lit("$").alias("path"), F.lit("invalid_json").alias("reason"))
    members = [F.struct(F.lit(name).alias("path"), (get(F.col("doc"), name, "variant").isNotNull() & ~F.coalesce(F.is_variant_null(get(F.col("doc"), name, "variant")), F.lit(True)) & listed(F.col("doc"), name).isNull()).alias("bad")) for name in ("response", "standings", "injuries")]
    no_lists = docs.select("raw_id", F.explode(F.array(*members)).alias("m")).where("m.bad").select("raw_id", F.lit("document").alias("entity_type"), "m.path", F.lit("invalid_payload").alias("reason"))
    kinds = {"fixture": fixtures(raw), "event": events(raw), "lineup": lineups(raw), "statistic": statistics(raw), "standing": standings(raw, league), "injury": injuries(raw)}
    out = broken.union(no_lists)
    for name, rows in kinds.items():
        out = out.union(rows.where(F.col("reason").isNotNull()).select("raw_id", F.lit(name), "path", "reason"))
    return out
