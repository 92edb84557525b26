"""Containment search of teams and rosters, retrieval and stages over many blocks, against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from skirmish.operators import containment as ct
from skirmish.operators import matching as mt

MEMBER = "struct<name:string,item:string,moves:array<string>>"


def some_teams(seed, n):
    """(lead, reserve): two thirds with one lead; names, items and moves may be unknown."""
    rng = random.Random(seed)
    member = lambda name: (name, rng.choice([None, "i", "j"]), sorted(rng.sample("mnop", rng.randint(0, 3))))
    for _ in range(n):
        names = rng.sample("bcdefg", rng.randint(0, 4))
        yield member(rng.choice("aaz")), [member(x) for x in names] + [member(None)] * rng.randint(0, 1)


def fits_set(p, c):
    return p[0] == c[0] and p[1] in (None, c[1]) and set(p[2]) <= set(c[2])


def fits_team(p, c):
    others = {m[0]: m for m in c[1] if m[0]}
    return fits_set(p[0], c[0]) and all(m[0] in others and fits_set(m, others[m[0]]) for m in p[1] if m[0])


def bare(team):
    """A team as a value: members without a name say nothing."""
    plain = lambda m: (m[0], m[1], tuple(m[2]))
    return plain(team[0]), frozenset(plain(m) for m in team[1] if m[0])


@pytest.mark.parametrize("carry", [True, False])
def test_teams_within_teams(spark, carry):
    teams = list(some_teams(1, 250))
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(teams)], f"team int, lead {MEMBER}, reserve array<{MEMBER}>")
    tokens = ct.team_tokens(df["lead"], df["reserve"], ["item"], ["moves"])
    known = ct.distinct_known(df, df["lead.name"], tokens)
    ids = {r.team: r.id for r in df.select("team", df["lead.name"].alias("key"), F.sort_array(F.array_distinct(tokens)).alias("tokens")).join(
        known.withColumnRenamed("key", "k2"), "tokens").where("key = k2").select("team", "id").collect()}
    values = {ids[i]: t for i, t in enumerate(teams)}
    assert len(values) == len({bare(t) for t in teams})
    want = {(a, b) for a in values for b in values if fits_team(values[a], values[b])}
    got = [(r.record, r.candidate) for r in ct.contained(known, known, F.col("id"), F.col("id"), carry).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    tips = {a for a in values if not any((a, b) in want for b in values if b != a)}
    weights = {r.id: r.weight for r in ct.leaf_weights(known, carry).collect()}
    assert weights == {t: sum((ids[i], t) in want for i in range(len(teams))) for t in tips}
    best = {}
    for r in ct.best_fits(known, ct.leaf_weights(known, carry), 2, carry).collect():
        best.setdefault(r.id, []).append((r.place, r.weight))
    for a in values:
        assert sorted(best[a]) == list(enumerate(sorted((weights[t] for t in tips if (a, t) in want), reverse=True)[:2], 1))


def test_nothing_contains_nothing(spark):
    none = spark.createDataFrame([], "id string, key string, tokens array<string>, copies long")
    assert ct.contained(none, none, F.col("id"), F.col("id")).count() == 0
    assert ct.leaf_weights(none, carry=False).count() == 0


def test_roster_scores(spark):
    teams = [(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["a", "d"]), (4, ["b", "c"])]
    names = spark.createDataFrame([(t, n) for t, ns in teams for n in ns], "team int, name string")
    shares = {(r.name, r.mate): r.share for r in mt.teammate_shares(names, "team", "name").collect()}
    assert shares["a", "b"] == pytest.approx(2 / 3) and shares["c", "b"] == 1 and ("d", "c") not in shares
    pairs = spark.createDataFrame([(1, "a", ["c"], ["b", "c"]), (2, "a", [], ["b", "d"]), (3, "z", ["y"], ["y", "x"]),
                                   (4, "a", ["b"], ["b"]), (5, "d", [], ["c"])], "id int, lead string, known array<string>, full array<string>")
    got = {r.id: r.log_score for r in mt.roster_scores(pairs, ["id"], "lead", "known", "full", mt.teammate_shares(names, "team", "name"), size=3).collect()}
    eps = math.log(1e-6)
    want = {1: 0.0, 2: math.log(2 / 3) + math.log(1 / 3), 3: eps, 4: eps, 5: eps + eps}
    assert got == pytest.approx(want)


def test_detail_scores(spark):
    usage = spark.createDataFrame([("e", "moves", "m", 0.5), ("e", "items", "i", 0.25)], "entity string, field string, key string, share double")
    pairs = spark.createDataFrame([(1, "e", 0), (2, "e", 2), (3, "u", 1), (4, "e", 1)], "id int, entity string, gaps int")
    diffs = spark.createDataFrame([(1, "moves", "m"), (1, "items", "i"), (1, "moves", "x"), (3, "moves", "m"), (3, "moves", "n"), (4, "moves", "m")],
                                  "id int, field string, key string")
    got = {r.id: r.log_score for r in mt.detail_scores(pairs, diffs, usage, ["id"], "entity", "gaps").collect()}
    eps = math.log(1e-6)
    assert got == pytest.approx({1: math.log(0.125) + eps, 2: 2 * eps, 3: eps, 4: math.log(0.5) + eps})


@pytest.mark.parametrize("seed", range(3))
def test_best_retrieval(spark, seed):
    rng = random.Random(seed)
    moves = lambda: sorted(rng.sample("klmno", rng.randint(0, 3)))
    members = [(t, n, moves()) for t in range(120) for n in rng.sample("hhxyzuvw", rng.randint(1, 4))]
    wanted = [(q, n, i, moves()) for q in range(60) for i, n in enumerate(rng.sample("hxyzuvw?!", rng.randint(1, 4)))] + [(99, "?", 0, ["k"])]
    got = {r.q: (r.team, r.matched, r.ratio) for r in mt.best_retrieval(
        spark.createDataFrame(wanted, "q int, name string, position int, wanted_moves array<string>"),
        spark.createDataFrame(members, "team int, name string, moves array<string>"), "q", "team", "name").collect()}
    sets = {}
    for t, n, m in members:
        sets.setdefault(t, {}).setdefault(n, []).append(set(m))
    for q, rows in itertools.groupby(wanted, key=lambda r: r[0]):
        rows = list(rows)
        total = sum(len(r[3]) for r in rows)
        options = []
        for t, own in sets.items():
            hit = [r for r in rows if r[1] in own]
            shared = sum(max(len(set(r[3]) & m) for m in own[r[1]]) for r in hit)
            options += [(-len(hit), -shared, [r[2] for r in hit], t)] if hit else []
        if not options:
            assert q not in got
        else:
            matched, shared, _, team = min(options)
            assert got[q] == (team, -matched, -shared / total if total else 0.0)


def test_retrieval_from_nothing(spark):
    wanted = spark.createDataFrame([(1, "a", 0, ["k"])], "q int, name string, position int, wanted_moves array<string>")
    none = spark.createDataFrame([], "team int, name string, moves array<string>")
    assert mt.best_retrieval(wanted, none, "q", "team", "name").count() == 0
    assert mt.best_retrieval(wanted.where("1 = 0"), none, "q", "team", "name").count() == 0


def test_pairs_are_tested_where_they_meet(spark):
    known = spark.createDataFrame([("1", "k", ["a"], 1), ("2", "k", ["a", "b"], 2), ("3", "k", [], 1)], "id string, key string, tokens array<string>, copies long")
    plan = ct.contained(known, known, F.col("id"), F.col("id"), carry=False)._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "array_except" in top and "code" in top  # no join of pairs by record or candidate, which would shuffle them
    assert "LeftSemi" in ct.leaves(known)._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, r.weight) for r in ct.leaf_weights(known).collect()] == [("2", 4)]


def test_codes_that_collide_are_drawn_again(spark, monkeypatch):
    code = ct._code
    monkeypatch.setattr(ct, "_code", lambda key, token, seed: F.length(token) if seed == 0 else code(key, token, seed))
    known = spark.createDataFrame([("1", "k", ["a"]), ("2", "k", ["b"]), ("3", "k", ["a", "b"])], "id string, key string, tokens array<string>")
    got = {(r.record, r.candidate) for r in ct.contained(known, known, F.col("id"), F.col("id")).collect()}
    assert got == {("1", "1"), ("2", "2"), ("3", "3"), ("1", "3"), ("2", "3")}


def test_large_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK", 3)
    rows = [(str(i), "k", [t for b, t in enumerate("abcde") if i >> b & 1]) for i in range(32)]
    known = spark.createDataFrame(rows, "id string, key string, tokens array<string>")
    got = [(r.record, r.candidate) for r in ct.contained(known, known, F.col("id"), F.col("id")).collect()]
    assert sorted(got) == sorted((a, b) for a, _, x in rows for b, _, y in rows if set(x) <= set(y))
    assert {r.id for r in ct.leaves(known).collect()} == {"31"}


def test_null_tokens(spark):
    rows = [("1", "k", ["a"], 1), ("2", "k", ["a", None], 2), ("3", "k", [], 4), ("4", None, ["a"], 8), ("5", "k", None, 16)]
    known = spark.createDataFrame(rows, "id string, key string, tokens array<string>, copies long")
    got = sorted((r.record, r.candidate) for r in ct.contained(known, known, F.col("id"), F.col("id")).collect())
    assert got == [("1", "1"), ("1", "2"), ("3", "1"), ("3", "2"), ("3", "3")]
    assert {(r.id, r.weight) for r in ct.leaf_weights(known).collect()} == {("2", 5)}
