"""Partial-record matching against brute force."""

import random

from pyspark.sql import functions as F

from skirmish.operators import matching as mt
from skirmish.operators import models


def brute_fits(p, c):
    return (p[0] == c[0] and all(a is None or a == b for a, b in zip(p[1:3], c[1:3])) and set(p[3]) <= set(c[3]))


def make(seed, n):
    rng = random.Random(seed)
    names = ["hot"] * 8 + ["x", "y"]
    return [(rng.choice(names), rng.choice([None, "i", "j"]), rng.choice([None, "a"]), tuple(sorted(rng.sample("mnop", rng.randint(0, 4)))))
            for _ in range(n)]


def test_pairs_leaves_weights(spark):
    recs = make(5, 300)
    df = spark.createDataFrame([(n, i, a, list(m)) for n, i, a, m in recs], "name string, item string, ability string, moves array<string>")
    d = mt.distinct_records(df, ["name"], ["item", "ability"], "moves")
    args = (["name"], ["item", "ability"], "moves")
    distinct = set(recs)
    key = lambda r: (r["name"], r["item"], r["ability"], tuple(r["moves"]))
    got = {(key(r["record"]), key(r["candidate"])) for r in mt.consistent_pairs(d, d, *args).collect()}
    assert got == {(p, c) for p in distinct for c in distinct if brute_fits(p, c)}
    tips = {c for c in distinct if not any(brute_fits(c, o) and o != c for o in distinct)}
    assert {key(r) for r in mt.leaves(d, *args).collect()} == tips
    weights = {key(r): r["weight"] for r in mt.leaf_weights(d, *args).collect()}
    assert weights == {t: sum(brute_fits(r, t) for r in recs) for t in tips}


def test_best_swaps_against_brute_force(spark):
    rng = random.Random(11)
    pool = [(i, i % 9, round(rng.uniform(-5, 5), 2)) for i in range(40)]
    score = {m: s for m, _, s in pool}
    clause = {m: c for m, c, _ in pool}
    teams = []
    for t in range(60):
        groups = rng.sample(range(9), 6)
        teams.append((t, sorted(rng.choice([m for m, c, _ in pool if c == g]) for g in groups)))
    got = {r["team"]: (r["out"], r["in"], round(r["gain"], 6)) for r in models.best_swaps(
        spark.createDataFrame(teams, "team int, members array<int>"), "team", "members",
        spark.createDataFrame(pool, "m int, c int, s double"), "m", "c", "s").collect()}
    for t, team in teams:
        best = max((score[c] - score[o] for o in team for c in score if c not in team
                    and clause[c] not in {clause[x] for x in team if x != o}), default=0)
        if best > 1e-9:
            assert abs(got[t][2] - best) < 1e-6
        else:
            assert t not in got


def test_layers_skip_empty_fields(spark):
    layer = lambda rows: spark.createDataFrame(rows, "entity string, field string, key string, share double")
    top = layer([("e", "tera", "Nothing", 1.0), ("e", "moves", "m1", 0.5), ("f", "tera", "Nothing", 1.0)])
    low = layer([("e", "tera", "Fire", 0.7), ("e", "moves", "m9", 0.9)])
    got = {(r["entity"], r["field"], r["key"]) for r in mt.layered_fallback([top, low], ["entity"]).collect()}
    assert got == {("e", "tera", "Fire"), ("e", "moves", "m1"), ("f", "tera", "Nothing")}


def test_retrieval_prefers_more_names_then_moves(spark):
    members = spark.createDataFrame([(1, "a", ["x"]), (1, "b", ["y"]), (2, "a", ["x", "z"]), (2, "c", ["w"]), (3, "a", ["x"])],
                                    "team int, name string, moves array<string>")
    wanted = spark.createDataFrame([(0, "a", 0, ["x", "z"]), (0, "b", 1, ["q"]), (0, "c", 2, ["w"])],
                                   "req int, name string, position int, wanted_moves array<string>")
    row = mt.best_retrieval(wanted, members, "req", "team", "name").first()
    assert (row["team"], row["matched"], row["ratio"]) == (2, 2, 0.75)


def test_payoff_is_antisymmetric(spark):
    s = spark.createDataFrame([(i, i * 0.3) for i in range(9)], "id int, s double")
    p = mt.payoff_table(s, "id", "s", lambda x, y: 1 / (1 + F.exp(y - x)))
    rows = {(r["a"], r["b"]): r["payoff"] for r in p.collect()}
    assert len(rows) == 81 and all(abs(rows[a, b] + rows[b, a]) < 1e-12 for a, b in rows)
