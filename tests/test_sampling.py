"""Draws, completions and models."""

import numpy as np
from pyspark.sql import functions as F

from skirmish.operators import models, sampling as sp


def options(spark):
    rows = [(f"N{i}", "teammates", f"N{j}" + ("-Form" if j % 7 == 0 else ""), 1.0 + (i * j) % 5) for i in range(12) for j in range(12) if i != j]
    return sp.option_lists(spark.createDataFrame(rows, "entity string, field string, key string, share double"), "entity")


def test_roster_completion(spark):
    teams = spark.createDataFrame([(i, [f"N{i % 12}", f"N{(i + 1) % 12}"]) for i in range(200)], "team long, members array<string>")
    out = sp.complete_roster(teams, "team", "members", options(spark), "entity", 6, "s").collect()
    again = {r["team"]: r["members"] for r in sp.complete_roster(teams.repartition(3), "team", "members", options(spark), "entity", 6, "s").collect()}
    for r in out:
        forms = [m.split("-")[0] for m in r["members"]]
        assert len(forms) == 6 == len(set(forms))
        assert r["members"][:2] == [f"N{r['team'] % 12}", f"N{(r['team'] + 1) % 12}"]
        assert again[r["team"]] == r["members"]


def test_move_completion_respects_conflicts(spark):
    opts = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(w).alias("share")) for k, w in
                     [("a", .5), ("b", .4), ("c", .1), ("d", .2), ("Hidden Power Ice", .3), ("Hidden Power Fire", .3), ("e", .1)]])
    df = spark.range(300).select("id", sp.complete_moves(F.array(F.lit("a")), opts, "s", [F.col("id").cast("string")],
                                                         {"a": ["b"], "b": ["a"], "c": ["d"], "d": ["c"]}).alias("m"))
    for r in df.collect():
        m = r["m"]
        assert m[0] == "a" and "b" not in m and not {"c", "d"} <= set(m) and len(set(m)) == len(m) <= 4
        assert sum(x.startswith("Hidden Power") for x in m) <= 1


def test_weighted_draw_follows_weights(spark):
    df = spark.range(4000).withColumn("k", F.explode(F.array(*[F.lit(x) for x in "abc"]))).withColumn(
        "w", F.when(F.col("k") == "a", 6.0).when(F.col("k") == "b", 3.0).otherwise(1.0))
    got = {r["k"]: r["count"] / 4000 for r in sp.weighted_draw(df, ["id"], "k", "w", 1, "s").groupBy("k").count().collect()}
    assert abs(got["a"] - .6) < .03 and abs(got["b"] - .3) < .03 and abs(got["c"] - .1) < .02


def test_posterior_draws(spark):
    df = spark.range(4000).select(F.col("id").alias("key"), F.lit(3.5).alias("alpha"), F.lit(1.5).alias("beta"))
    a = sp.posterior_draws(df.repartition(7), "key", "s").orderBy("key").toPandas()["draw"].to_numpy()
    b = sp.posterior_draws(df.coalesce(1), "key", "s").orderBy("key").toPandas()["draw"].to_numpy()
    assert np.array_equal(a, b)
    assert abs(a.mean() - .7) < .01 and abs(a.var() - .7 * .3 / 6) < .003


def test_split_sizes(spark):
    got = {r["split"]: r["count"] for r in sp.train_test_split(spark.range(1003), ["id"], 0.1, 1).groupBy("split").count().collect()}
    assert got == {"train": int(1003 * 0.9), "test": 1003 - int(1003 * 0.9)}


def test_mixture_flattening():
    cfg = {"a": {"sources": {"x": 3, "y": 1}}, "b": {"previous": "a", "prev_weight": 0.5, "sources": {"z": 0.3}}}
    got = {e["source"]: (e["weight"], e["is_new"]) for e in sp.flatten_mixture("b", cfg)}
    assert got == {"x": (0.375, False), "y": (0.125, False), "z": (0.3, True)}


def test_curriculum_grows():
    assert sp.curriculum_range(0) == (0.0, 0.25) and sp.curriculum_range(20_000) == (0.0, 1.0)


def test_baseline_model_recovers_order(spark):
    rng = np.random.default_rng(0)
    theta = np.linspace(-1, 1, 8)
    rows = []
    for i in range(1500):
        a, b = sorted(rng.choice(8, 3, False).tolist()), sorted(rng.choice(8, 3, False).tolist())
        p = 1 / (1 + np.exp(theta[b].sum() - theta[a].sum()))
        rows.append((i, a, b, int(rng.random() < p)))
    ex = spark.createDataFrame(rows, "id long, a array<int>, b array<int>, y int")
    weights, metrics, intercept = models.fit_baseline(ex, "id", "a", "b", "y", max_iter=60)
    got = {int(r["member"]): r["weight"] for r in weights.collect()}
    est = np.array([got[i] for i in range(8)])
    assert np.corrcoef(est, theta)[0, 1] > 0.95 and abs(est.mean()) < 1e-9 and abs(intercept) < 0.05
    m = metrics.first()
    assert m["log_loss"] < 0.68 and m["accuracy"] > 0.55
    scored = models.win_probability(models.make_scorer("baseline")(ex, "id", "a", "b", weights, intercept))
    assert scored.where("p between 0 and 1").count() == 1500
