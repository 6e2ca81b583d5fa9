"""The whole table's audit against a plain search, with planted faults."""

import datetime as dt
import random
from collections import Counter

from pitsight.operators import elo
from pitsight.plans import audits, history
from pyspark.sql import functions as F

SCHEMA = "match_id long, kickoff_at timestamp_ntz, home_team_id long, away_team_id long, league string, season int, status string, home_score int, away_score int, available_at timestamp_ntz"


def test_every_row_is_checked(spark):
    rng, rows = random.Random(5), []
    for i in range(1, 61):
        at = dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randrange(120))
        a, b = rng.sample(range(5), 2)
        done = rng.random() < 0.9
        # Match 7's result is known before its kickoff.
        known = at + dt.timedelta(hours=-1 if i == 7 else 3)
        rows.append((i, at, a, b, rng.choice("XY"), 2020, "finished" if done or i == 7 else "scheduled", rng.randrange(3) if done or i == 7 else None, rng.randrange(3) if done or i == 7 else None, known if done or i == 7 else None))
    m = spark.createDataFrame(rows, SCHEMA)
    table = history.features(m).where("status = 'finished'")
    table = table.withColumn("away_matches_played", F.col("away_matches_played") + F.when(F.col("match_id") % 5 == 0, 40).otherwise(0))
    table = table.withColumn("home_elo_pre", F.col("home_elo_pre") + F.when(F.col("match_id") % 7 == 1, 1.0).otherwise(0.0)).checkpoint()
    ratings = {r["match_id"]: (r["home_elo"], r["away_elo"]) for r in elo.elo_walk(m).collect()}
    built, by_id = table.collect(), {r[0]: r for r in rows}
    shared = Counter((r["league"], r["kickoff_at"]) for r in built)
    wanted = {}
    for r in built:
        i, at, home, away, *_ = by_id[r["match_id"]]
        seen = [sum(x[0] != i and x[6] == "finished" and team in x[2:4] and x[9] < at for x in rows) for team in (home, away)]
        found = wanted.setdefault(r["league"], [0] * 5)
        found[0] += 1
        found[1] += shared[r["league"], at] > 1
        found[2] += r["home_matches_played"] > seen[0] or r["away_matches_played"] > seen[1]
        found[3] += by_id[i][9] < at
        found[4] += (r["home_elo_pre"], r["away_elo_pre"]) != ratings[i]
    got = {r["league"]: [r["n"], r["tied"], r["future_rows"], r["self_rows"], r["elo_mismatches"]] for r in audits.pit_checks(table, m).collect()}
    assert got == wanted
    assert all(sum(x[k] for x in wanted.values()) > 0 for k in range(5))
