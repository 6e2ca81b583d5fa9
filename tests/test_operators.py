"""Small hand-made tables: ties, empty windows, cutoffs, edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitsight.functions import odds as O
from pitsight.functions import text as X
from pitsight.functions import times
from pitsight.operators import asof, elo, fixtures, form, identity, intake, metrics, slots, value

DAY = dt.datetime(2024, 3, 1, 12)


def hours(n):
    return dt.timedelta(hours=n)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


SNAPSHOTS = "snapshot_id long, match_id long, kickoff_at timestamp_ntz, available_at timestamp_ntz, home_odds double, draw_odds double, away_odds double, age_h int, bookmaker long"


def snapshots(spark, rows):
    return spark.createDataFrame([(i, m, DAY, DAY + hours(at), 2.0, 4.0, away, -at, i % 3) for i, m, at, away in rows], SNAPSHOTS)


def test_asof_rules(spark):
    rows = snapshots(spark, [(1, 1, -5, 5.0), (2, 1, 0, 5.0), (3, 1, 0, 5.0), (4, 1, 1, 5.0), (5, 2, -3, 5.0), (6, 2, -1, None), (7, 3, 2, 5.0), (8, 4, -1, None)])
    inclusive = {r["match_id"]: r["snapshot_id"] for r in asof.latest_odds(rows).collect()}
    # At the cutoff counts, ties go to the larger id, and an earlier complete market wins over a later incomplete one.
    assert inclusive == {1: 3, 2: 5}
    strict = {r["match_id"]: r["snapshot_id"] for r in asof.latest_odds(rows, inclusive=False, complete_only=False).collect()}
    assert strict == {1: 1, 2: 6, 4: 8}
    matches = spark.createDataFrame([(m,) for m in range(1, 6)], "match_id long")
    assert {r["match_id"]: r["status"] for r in asof.odds_status(matches, rows).collect()} == {1: "ok", 2: "ok", 3: "future_only", 4: "incomplete", 5: "unavailable"}
    assert asof.latest_odds(rows.limit(0)).count() == 0


def test_future_rows_change_nothing(spark):
    rows = snapshots(spark, [(1, 1, -5, 5.0), (2, 2, -4, 5.0)])
    later = snapshots(spark, [(9, 1, 24, 9.0), (10, 2, 1, 9.0)])
    assert sorted(asof.latest_odds(rows).collect()) == sorted(asof.latest_odds(rows.union(later)).collect())


def test_bands(spark):
    left = spark.createDataFrame([(0, 1000), (1, 1121), (2, -119)], "a long, t long")
    right = spark.createDataFrame([(0, 1000), (1, 880), (2, 0)], "b long, u long")
    assert sorted((r["a"], r["b"]) for r in asof.band_join(left, right, "t", "u", 120).collect()) == [(0, 0), (0, 1), (2, 2)]


def test_market_arithmetic(spark):
    h, d, a = F.lit(2e0), F.lit(4e0), F.lit(5e0)
    fair = O.no_vig(h, d, a)
    r = one(spark, over=O.overround(h, d, a), total=fair[0] + fair[1] + fair[2], edge=O.edge(F.lit(0.55), h), ev=O.expected_value(F.lit(0.55), h), bad=O.implied(F.lit(1e0)), part=O.overround(h, d, F.lit(None).cast("double")))
    assert r["over"] == pytest.approx(0.95) and r["total"] == 1.0 and r["edge"] == pytest.approx(0.05) and r["ev"] == pytest.approx(0.1)
    assert r["bad"] is None and r["part"] is None
    r = one(spark, won=O.settle(F.lit("HOME"), F.lit("HOME"), F.lit(2.5)), lost=O.settle(F.lit("HOME"), F.lit("DRAW"), F.lit(2.5), 2e0), open=O.settle(F.lit("HOME"), F.lit(None).cast("string"), F.lit(2.5)))
    assert (r["won"], r["lost"], r["open"]) == (1.5, -2.0, None)


def test_probabilities(spark):
    p, q = O.elo_1x2(F.lit(0e0)), O.poisson_1x2(F.lit(1.4), F.lit(1.1))
    r = one(spark, s=p[0] + p[1] + p[2], draw=p[1], t=q[0] + q[1] + q[2], ahead=q[0] > q[2], tie=O.argmax_1x2(F.lit(0.4), F.lit(0.4), F.lit(0.2)), low=O.argmax_1x2(F.lit(0.2), F.lit(0.4), F.lit(0.4)))
    assert r["s"] == pytest.approx(1) and r["draw"] == pytest.approx(0.26) and r["t"] == pytest.approx(1) and r["ahead"]
    assert (r["tie"], r["low"]) == ("HOME", "DRAW")


MATCHES = "match_id long, kickoff_at timestamp_ntz, home_team_id long, away_team_id long, league string, status string, home_score int, away_score int, available_at timestamp_ntz"


def matches(spark, rows):
    out = []
    for i, at, h, a, hs, as_ in rows:
        done = hs is not None
        out.append((i, DAY + hours(at), h, a, "L", "finished" if done else "scheduled", hs, as_, DAY + hours(at + 3) if done else None))
    return spark.createDataFrame(out, MATCHES)


def test_form_sees_only_known_results(spark):
    m = matches(spark, [(1, 0, 1, 2, 2, 0), (2, 3, 1, 3, 1, 1), (3, 4, 1, 2, 0, 1), (4, 4, 1, 3, 3, 0), (5, 30, 2, 1, None, None)])
    got = {(r["match_id"], r["side"]): r for r in form.rolling_form(m).collect()}
    assert got[1, "home"]["played"] == 0 and got[1, "home"]["points_5"] == 0 and got[1, "home"]["available_5"] == 0
    # Three hours after kickoff isn't strictly before: the second match doesn't see the first, the third does.
    assert got[2, "home"]["played"] == 0 and got[3, "home"]["played"] == 1 and got[3, "home"]["points_5"] == 3
    # Of two at one time, neither sees the other.
    assert got[4, "home"]["played"] == 1
    last = got[5, "away"]
    assert (last["played"], last["points_5"], last["goals_for_5"], last["goals_against_5"]) == (4, 3 + 1 + 0 + 3, 6, 2)
    met = {r["match_id"]: r for r in form.head_to_head(m).collect()}
    assert (met[5]["meetings"], met[5]["home_wins"], met[5]["away_wins"], met[5]["available"]) == (2, 1, 1, 1)


def test_ratings_wait_for_results(spark):
    m = matches(spark, [(1, 0, 1, 2, 2, 0), (2, 3, 1, 3, 1, 1), (3, 4, 1, 2, None, None)])
    got = {r["match_id"]: r for r in elo.elo_walk(m).collect()}
    assert got[1]["home_elo"] == got[2]["home_elo"] == 1500.0
    expected = 1 / (1 + 10 ** ((1500 - 1580) / 400))
    assert got[3]["home_elo"] == pytest.approx(1500 + 20 * (1 - expected)) and got[3]["away_elo"] == pytest.approx(1500 - 20 * (1 - expected))
    assert elo.elo_walk(m.limit(0)).count() == 0


def test_gates_and_ranks(spark):
    rows = [(1, "HOME", 24, 0.5, 0.1, 0.05), (2, "HOME", 25, 0.5, 0.1, 0.05), (3, "HOME", 1, 0.5, -0.1, 0.05), (4, "HOME", 1, 0.5, 0.1, -0.05), (5, "AWAY", 1, 0.5, 0.1, 0.05)]
    gated = value.gated(spark.createDataFrame(rows, "match_id long, selection string, age_h int, p double, ev double, edge double"))
    assert {r["match_id"]: r["reason"] for r in gated.collect()} == {1: None, 2: "stale_odds", 3: "negative_ev", 4: "negative_edge", 5: None}
    top = value.top_picks(gated.where("reason IS NULL"), 5)
    # Same score: the fresher one comes first.
    assert [(r["pick_rank"], r["match_id"]) for r in top.orderBy("pick_rank").collect()] == [(1, 5), (2, 1)]
    assert sorted(top.collect()) == sorted(value.top_picks(gated.where("reason IS NULL").orderBy(F.desc("match_id")), 5).collect())


BETS = "league string, kickoff_at timestamp_ntz, match_id long, selection string, hit int, profit double, odds double, edge double, ev double"


def bets(spark, profits):
    return spark.createDataFrame([("L", DAY, i, "HOME", int(x > 0), float(x), 2.0, 0.1, 0.2) for i, x in enumerate(profits)], BETS)


def test_equity_drawdown_streak_and_factor(spark):
    x = bets(spark, [-1, -1, 2, -1, -1, -1, 1])
    curve = metrics.equity(x, ["league"]).orderBy("match_id").collect()
    assert [r["equity"] for r in curve] == [-1, -2, 0, -1, -2, -3, -2]
    # The peak starts at zero, before any gain.
    assert curve[1]["drawdown"] == 2 and max(r["drawdown"] for r in curve) == 3
    assert metrics.losing_streaks(x, ["league"]).first()["longest_losing_streak"] == 3
    assert metrics.profit_factor(x, ["league"]).first()["profit_factor"] == pytest.approx(3 / 5)
    assert metrics.profit_factor(bets(spark, [1, 2]), ["league"]).first()["profit_factor"] == float("inf")
    assert metrics.profit_factor(bets(spark, [0]), ["league"]).first()["profit_factor"] is None


def test_bins_and_buckets(spark):
    edges = [0.0, 0.1, 0.3, 0.6, 0.7, 0.9999, 1.0]
    got = [r["b"] for r in spark.createDataFrame([(i, p) for i, p in enumerate(edges)], "i int, p double").select("i", metrics.bin_of(F.col("p")).alias("b")).orderBy("i").collect()]
    # Edges are multiples of a tenth in double arithmetic, of which the third, sixth and seventh lie above the literal.
    assert got == [0, 1, 2, 5, 6, 9, 9]
    rows = spark.createDataFrame([(-0.1, 1, 1.0), (0.0, 0, -1.0), (0.15, 1, 2.0)], "ev double, hit int, profit double")
    found = {r["label"]: r["n"] for r in metrics.buckets(rows, "ev", [("low", 0.0, 0.15), ("high", 0.15, None), ("never", 5.0, 6.0)]).collect()}
    assert found == {"low": 1, "high": 1, "never": 0}


def test_keys_and_text(spark):
    r = one(
        spark, a=X.slugify(F.lit("  São Paulo F.C. ")), b=X.slugify(F.lit("!!")), c=X.canonical_id("team", F.lit("Á b"), F.lit(""), F.lit("C")), d=X.reversed_key(F.lit("football|a|b|2024|x")), e=X.reversed_key(F.lit("a|b")),
        f=X.percent(F.lit(0.12345)), g=F.size(X.sentences(F.lit("One. Two!  Three? "))), h=X.market_selection(F.lit("dRaW"), F.lit("A"), F.lit("B")), i=X.event_id_of(F.lit("ev1:bm:h2h")),
    )
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"], r["g"], r["h"], r["i"]) == ("sao-paulo-f-c", "unknown", "team_a-b-c", "football|b|a|2024|x", None, "12,3 %", 3, "DRAW", "ev1")


def test_times(spark):
    at = F.lit(DAY)
    r = one(
        spark, a=times.result_available_at(at, at + F.expr("INTERVAL 5 HOURS")), b=times.result_available_at(at, at - F.expr("INTERVAL 1 HOUR")), c=times.freshness(F.lit("odds"), F.lit(900)), d=times.freshness(F.lit("odds"), F.lit(7201)),
        e=times.freshness(F.lit("fixtures"), F.lit(99_999), F.lit(True)), f=times.overlaps(F.lit(None).cast("date"), F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 2, 1))),
        g=fixtures.lenient_time(F.lit("1709294400")), h=fixtures.lenient_time(F.lit("2024-03-01T12:00:00Z")), i=fixtures.lenient_time(F.lit("soon")),
    )
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == (DAY + hours(3), DAY + hours(1.5), "fresh", "stale", "fresh", True)
    assert (r["g"], r["h"], r["i"]) == (DAY, DAY, None)


def test_flattened_odds_name_their_faults(spark):
    price = lambda n, p: {"name": n, "price": p}
    sound = [price("A", 2.0), price("Draw", 3.0), price("B", 4.0)]
    books = {"ok": sound, "unknown_outcome": [*sound[:2], price("C", 4.0)], "duplicate_outcome": [*sound[:2], sound[0]], "invalid_price": [*sound[:2], price("B", 1.0)], "incomplete_market": sound[:2]}
    body = [("e1", "s", "t", "A", "B", [{"key": k, "title": k, "last_update": None, "markets": [{"key": "h2h", "outcomes": o}]} for k, o in books.items()] + [{"key": "unsupported_market", "title": "", "last_update": None, "markets": [{"key": "totals", "outcomes": sound}]}])]
    got = {r["bookmaker"]: r["reason"] for r in intake.flatten_odds(spark.createDataFrame(body, intake.EVENT_SCHEMA)).collect()}
    assert got == {k: None if k == "ok" else k for k in [*books, "unsupported_market"]}


def test_first_last_upsert_and_conflicts(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), ("a", 2, 2.0)], "k string, t int, v double")
    assert {r["k"]: r["v"] for r in intake.first_wins(rows, ["k"], ["t", "v"]).collect()} == {"a": 1.0, "b": 3.0}
    assert {r["k"]: r["v"] for r in intake.last_wins(rows, ["k"], ["t", "v"]).collect()} == {"a": 2.0, "b": 3.0}
    arriving = spark.createDataFrame([("b", 0, 9.0), ("c", 0, 8.0)], rows.schema)
    stored = intake.last_wins(rows, ["k"], ["t", "v"])
    assert {r["k"]: r["v"] for r in intake.upsert(stored, arriving, ["k"], ["t"], True).collect()} == {"a": 2.0, "b": 9.0, "c": 8.0}
    kept = intake.upsert(stored, arriving, ["k"], ["t"], False)
    assert {r["k"]: r["v"] for r in kept.collect()} == {"a": 2.0, "b": 3.0, "c": 8.0}
    # Again the same arrivals: nothing changes.
    assert sorted(intake.upsert(kept, arriving, ["k"], ["t"], False).collect()) == sorted(kept.collect())
    assert [r["k"] for r in intake.conflicts(rows, ["k"], ["v"]).collect()] == ["a"]


def test_slots(spark):
    times_ = [0, 11, 12, 13, 24, 25, 36]
    thin = intake.thinned(spark.createDataFrame([("g", t) for t in times_], "g string, t long"), "g", "t", 12)
    assert sorted(r["t"] for r in thin.collect()) == [0, 12, 24, 36]
    costs = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 1), ("h", 1, 20)], "g string, o int, c int")
    # The first slot over the budget ends the run, though a later one would fit.
    assert [(r["g"], r["o"]) for r in slots.within_budget(costs, "g", ["o"], "c", 10).collect()] == [("g", 1)]
    rows = spark.createDataFrame([("a", True, False, False), ("b", False, True, False), ("c", False, False, True), ("c", False, True, False), ("d", False, False, False), ("d", False, True, False)], "s string, requested boolean, covered boolean, excluded boolean")
    assert {r["s"]: r["state"] for r in slots.partition(rows, ["s"]).collect()} == {"a": "requested", "b": "covered", "c": "identity_only", "d": "fetch"}


def test_identity(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "two"), (3, "c", "one"), (4, "d", "zzz")], "provider_id long, name string, slug string")
    known = spark.createDataFrame([(10, 1, "q"), (11, None, "one"), (12, None, "two"), (13, None, "two")], "team_id long, provider_id long, slug string")
    aliases = spark.createDataFrame([(9, 10)], "alias_id long, team_id long")
    assert {r["provider_id"]: (r["method"], r["team_id"]) for r in intake.resolve_teams(rows, known, aliases).collect()} == {1: ("provider_id", 10), 2: ("ambiguous", None), 3: ("name", 11), 4: ("new", None)}
    events = spark.createDataFrame([(1, "k1", "a1", "r1"), (2, "k2", "k1", "r2"), (3, "k3", "a3", "k1"), (4, "k4", None, None)], "event_id long, key string, alias_key string, reversed_key string")
    catalog = spark.createDataFrame([(7, "k1"), (8, "k1")], "match_id long, key string")
    assert {r["event_id"]: (r["status"], r["match_id"]) for r in intake.match_events(events, catalog).collect()} == {1: ("exact", 7), 2: ("alias", 7), 3: ("inverted", 7), 4: ("unmatched", None)}
    found = identity.alias_problems(spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "z"), ("c", "c")], "alias string, name string"))
    assert sorted((r["problem"], r["alias"]) for r in found.collect()) == [("ambiguous", "b"), ("identity", "c"), ("repeated", "a")]


NAMES = {"Beşiktaş": "besiktas", "Dinamo București": "dinamo-bucuresti", "Bodø/Glimt": "bod-glimt", "Großaspach": "groaspach", "Łódź": "odz", "ﬁne ½ ™": "fine-12-tm", "Cafe\u0301": "cafe", "Αθήνα": "unknown", "": "unknown"}


def test_slugs_by_compatibility_decomposition(spark):
    import re
    import unicodedata

    rows = [(name,) for name in [*NAMES, *(f"a{chr(c)}b" for c in range(0x80, 0x3000))]]
    got = {r["name"]: r["slug"] for r in spark.createDataFrame(rows, "name string").select("name", X.slugify(F.col("name")).alias("slug")).collect()}
    for name, slug in got.items():
        plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
        assert slug == (re.sub("[^a-z0-9]+", "-", plain).strip("-") or "unknown") and NAMES.get(name, slug) == slug


def test_search_folding_keeps_letters_of_their_own(spark):
    r = one(spark, a=X.folded(F.lit("ÉTÉ Beşiktaş Ærø Cafe\u0301")))
    assert r["a"] == "ete besiktas ærø cafe"


def test_one_timeline_across_competitions_and_pools(spark):
    rows = [(1, "a", 0, 1, "2020-01-01", 2, 0), (2, "b", 0, 2, "2020-01-05", 1, 1), (3, "a", 1, 2, "2020-01-09", 0, 3), (4, "b", 0, 1, "2020-01-12", None, None)]
    m = spark.createDataFrame(rows, "match_id long, league string, home_team_id long, away_team_id long, day string, home_score int, away_score int")
    m = m.withColumn("kickoff_at", F.col("day").cast("timestamp_ntz")).withColumn("available_at", F.when(F.col("home_score").isNotNull(), F.col("kickoff_at") + F.expr("INTERVAL 3 HOURS")))

    def plain(matches, k=20.0, ha=80.0):
        r, out = {}, {}
        for i, _, h, a, _, hs, as_ in matches:
            x, y = r.get(h, 1500.0), r.get(a, 1500.0)
            out[i] = (x, y)
            if hs is not None:
                e = 1 / (1 + 10 ** ((y - (x + ha)) / 400))
                s = 1.0 if hs > as_ else 0.5 if hs == as_ else 0.0
                r[h], r[a] = x + k * (s - e), y + k * ((1 - s) - (1 - e))
        return out

    got = {r["match_id"]: (r["home_elo"], r["away_elo"]) for r in elo.elo_walk(m.repartition(3)).collect()}
    assert got == plain(rows)
    apart = {r["match_id"]: (r["home_elo"], r["away_elo"]) for r in elo.elo_walk(m, pool="league").collect()}
    assert apart == plain([r for r in rows if r[1] == "a"]) | plain([r for r in rows if r[1] == "b"]) != got
    cells = {(r["k"], r["ha"], r["match_id"]): (r["home_elo"], r["away_elo"]) for r in elo.elo_grid(m, (10, 30), (0, 100)).collect()}
    assert all(cells[k, ha, i] == v for k in (10, 30) for ha in (0, 100) for i, v in plain(rows, k, ha).items()) and len(cells) == 16


def test_fingerprints_count_repeats_and_see_every_column(spark):
    rows = [(1, "a", 0.5), (1, "b", 0.25), (2, "a", 0.5)]
    f = lambda r: {x["g"]: (x["n"], x["fingerprint"]) for x in metrics.fingerprints(spark.createDataFrame(r, "g long, s string, p double"), ["g"], ["s", "p"]).collect()}
    base = f(rows)
    assert f(rows[::-1]) == base and f([*rows, rows[0]])[1] != base[1] and f([(1, "a", 0.5000001), *rows[1:]])[1] != base[1] and f([(1, "a", 0.5000001), *rows[1:]])[2] == base[2]


def test_band_join_on_further_keys(spark):
    left = spark.createDataFrame([(1, 100, "x"), (2, 100, "y")], "a long, t1 long, k1 string")
    right = spark.createDataFrame([(7, 220, "x"), (8, 221, "x"), (9, -20, "y")], "b long, t2 long, k2 string")
    got = asof.band_join(left, right, "t1", "t2", 120, {"k1": "k2"})
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(1, 7), (2, 9)]


def test_audit_by_counted_values(spark):
    rows = [(1.0,), (1.0,), (4.0,), (None,)]
    r = intake.audit(spark.createDataFrame(rows, "x double"), ["x"]).first()
    assert (r["n"], r["null_rate"], r["n_distinct"], r["low"], r["high"], r["mean"], r["p50"]) == (4, 0.25, 2, 1.0, 4.0, 2.0, 1.0)
    assert r["std"] == pytest.approx(2 ** 0.5)


def test_ratings_do_not_depend_on_the_ranges_of_time(spark):
    from pitsight.operators import elo
    from pitsight.sources import bridge

    m = bridge.matches(spark, "/root/testdata/sf0.001").withColumn("league", F.when(F.col("league") != "5-LOW", F.col("league")))
    for pool in (None, "league"):
        for ks in ([20.0], [10.0, 30.0]):
            whole = elo.rated(m, ks, [80.0] * len(ks), pool)
            cut = elo.rated(m, ks, [80.0] * len(ks), pool, range_events=500)
            order = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[1])
            assert order(whole) == order(cut) and whole.count() == m.count()


def test_a_fold_takes_no_more_than_a_range_of_one_time(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(elo, "written", lambda df, *by, write=elo.written: kept.append(write(df, *by)) or kept[-1])
    m = spark.range(300).select(F.col("id").alias("match_id"), F.lit(DAY).alias("kickoff_at"), F.lit(DAY + hours(3)).alias("available_at"), (F.col("id") % 7).alias("home_team_id"), (F.col("id") % 5 + 7).alias("away_team_id"), F.lit(1).alias("home_score"), (F.col("id") % 3).alias("away_score"), F.concat(F.lit("n"), "id").alias("note"))
    cut = elo.rated(m, [20.0], [80.0], None, range_events=100, carry=("note",))
    assert max(r["n"] for r in kept[1].groupBy("range").agg(F.sum(F.size("match_id")).alias("n")).collect()) < 300 and kept[1].select("range").distinct().count() > 2
    whole = elo.rated(m, [20.0], [80.0], None, carry=("note",))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect())) and {r["note"] for r in cut.where("match_id = 9").collect()} == {"n9"}


def test_percentiles_hold_no_group_in_one_map(spark):
    from pitsight.operators import metrics

    rows = spark.createDataFrame([(g, x) for g, n in (("a", 41), ("b", 7), (None, 3), ("c", 1)) for i in range(n) for x in [(i * 37 % 11) / 7, None, 0.25]] + [("none", None)], "g string, x double")
    found = metrics.exact_percentiles(rows, "x", {"p10": 0.1, "p50": 0.5, "p95": 0.95}, ["g"])
    wanted = rows.where("x IS NOT NULL").groupBy("g").agg(*(F.percentile("x", p).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p95", 0.95))))
    near = lambda df: {r["g"]: pytest.approx(tuple(r)[1:]) for r in df.collect()}
    assert {r["g"]: tuple(r)[1:] for r in found.collect()} == near(wanted)
    both = elo.agreement(spark.createDataFrame([(1, "a", 1.0), (2, None, 5.0)], "match_id long, g string, elo_diff double"), spark.createDataFrame([(1, 2.5), (2, 5.0)], "match_id long, elo_diff double"), ["g"])
    assert {tuple(r) for r in both.collect()} == {("a", 1, 1.5, 1.5, 1.5), (None, 1, 0.0, 0.0, 0.0)}
