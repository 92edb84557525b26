"""Ordered scans on a key that holds nearly all rows, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skirmish.operators import aggregates, ordered, pairs, windows


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.9, 0, rng.integers(1, 40, n)), "pos": np.arange(n)})
    pdf["x"] = np.where(rng.random(n) < 0.05, rng.integers(0, 9, n).astype(float), np.nan)
    pdf["seg"] = pdf["pos"] // 64
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(8)
    return df, pdf.sort_values(["k", "pos"])


def _got(df, name):
    return df.select("pos", name).toPandas().set_index("pos")[name].sort_index()


def _same(got, want):
    pd.testing.assert_series_equal(got.astype(float), want.sort_index().astype(float), check_names=False)


def test_running(skewed):
    df, pdf = skewed
    out = ordered.running(df, ["k"], "seg", ["pos"], {
        "last": ("last", F.col("x")), "n": ("count", F.col("x")), "top": ("max", F.col("x"))}).cache()
    by = pdf.set_index("pos").groupby("k")["x"]
    _same(_got(out, "last"), by.ffill())
    _same(_got(out, "n"), by.transform(lambda s: s.notna().cumsum()))
    _same(_got(out, "top"), by.transform(lambda s: s.cummax().ffill()))


def test_first_and_set(skewed):
    df, pdf = skewed
    out = ordered.running(df, ["k"], "seg", ["pos"], {"f": ("first", F.col("x")), "s": ("set", F.col("x"))})
    out = out.withColumn("size", F.size("s")).cache()
    by = pdf.set_index("pos").groupby("k")["x"]
    _same(_got(out, "f"), by.transform(lambda s: s.where(s.index >= (s.first_valid_index() or 0), np.nan).bfill().ffill()
                                       .where(s.index >= (s.first_valid_index() if s.first_valid_index() is not None else 10**9))
                                       if s.notna().any() else s).pipe(lambda v: v.groupby(pdf.set_index("pos")["k"]).transform("first").where(v.notna())))
    _same(_got(out, "size"), by.transform(lambda s: pd.Series([s.iloc[:i + 1].dropna().nunique() for i in range(len(s))], index=s.index)))


def test_following_and_neighbours(skewed):
    df, pdf = skewed
    back = ordered.following(df, ["k"], "seg", ["pos"], {"b": ("first", F.col("x"))})
    by = pdf.set_index("pos").groupby("k")
    _same(_got(back, "b"), by["x"].bfill())
    pdf2 = pdf.set_index("pos").assign(p=lambda d: d.index)
    nb = ordered.neighbours(df, ["k"], "seg", ["pos"], lead={"nx": F.col("pos")}, lag={"pv": F.col("pos")}).cache()
    _same(_got(nb, "nx"), pdf2.groupby("k")["p"].shift(-1))
    _same(_got(nb, "pv"), pdf2.groupby("k")["p"].shift(1))


def test_ranked_and_history(skewed):
    df, pdf = skewed
    r = ordered.ranked(df, ["k"], F.col("seg"), ["pos"], "rn", total="n").cache()
    by = pdf.set_index("pos").groupby("k")["seg"]
    _same(_got(r, "rn"), by.cumcount() + 1)
    _same(_got(r, "n"), by.transform("size"))
    h = ordered.history(df, ["k"], "seg", ["pos"], F.col("pos"), 70, "h").select("k", "pos", "h").collect()
    order = pdf.groupby("k")["pos"].apply(list)
    for row in h:
        at = order[row["k"]].index(row["pos"])
        assert row["h"] == order[row["k"]][max(0, at - 70):at + 1]


def test_no_task_holds_the_hot_key(skewed):
    df, _ = skewed
    out = ordered.running(df, ["k"], "seg", ["pos"], {"last": ("last", F.col("x"))})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    rows = [line for line in plan.splitlines() if "Window" in line and "seg" in line]
    assert rows  # row windows are keyed by segment as well


@pytest.mark.parametrize("block", [128, 3])
def test_stage_values_across_segments(spark, monkeypatch, block):
    monkeypatch.setattr(windows, "_BLOCK", block)
    rng = np.random.default_rng(3)
    kinds = rng.choice(["up", "down", "reset", "swap"], 400, p=[.45, .35, .05, .15])
    amount = rng.integers(1, 4, 400)
    side = rng.integers(1, 3, 400)
    pdf = pd.DataFrame({"k": 1, "pos": np.arange(400), "kind": kinds, "n": amount, "side": side})
    pdf["seg"] = pdf["pos"] // 16
    df = spark.createDataFrame(pdf)
    sm = windows.stage_map

    def slot(me, foe):
        mine = F.col("side") == me
        return (F.when(F.col("kind") == "swap", sm(foe, 1, 0, -6, 6))
                .when(mine & (F.col("kind") == "up"), sm(me, 1, F.col("n"), -6, 6))
                .when(mine & (F.col("kind") == "down"), sm(me, 1, -F.col("n"), -6, 6))
                .when(mine & (F.col("kind") == "reset"), sm(me, 1, 0, 0, 0)).otherwise(sm(me, 1, 0, -6, 6)))

    got = windows.stage_values(df, ["k"], "seg", ["pos"], slot(1, 2), slot(2, 1)).toPandas().set_index("pos").sort_index()
    v = {1: 0, 2: 0}
    for i, (kind, n, s) in enumerate(zip(kinds, amount, side)):
        if kind == "swap":
            v = {1: v[2], 2: v[1]}
        else:
            v[s] = 0 if kind == "reset" else max(-6, min(6, v[s] + (n if kind == "up" else -n)))
        assert (got.loc[i, "stage1"], got.loc[i, "stage2"]) == (v[1], v[2])


def test_pairs_of_a_large_group(spark):
    df = spark.range(300).withColumn("g", F.when(F.col("id") < 280, 0).otherwise(1))
    out = pairs.unordered_pairs(df, ["g"], "id", block=32)
    assert out.count() == 280 * 279 // 2 + 20 * 19 // 2
    assert out.distinct().count() == out.count()
    assert out.where("a >= b").count() == 0


def test_names_seen_so_far(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice([1, 1, 1, 2, 3], 500), "pos": np.arange(500), "x": [f"n{v:02d}" if v < 30 else None for v in rng.integers(0, 60, 500)]})
    pdf["seg"] = pdf["pos"] // 16
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k int, pos int, x string, seg int")
    shown = windows.ever_and_revealed(df, ["k"], "seg", ["pos"], {"late": F.col("pos") > 300}, F.col("x"), width=4)
    assert shown.columns == ["k", "pos", "x", "seg", "late", "seen"]
    counts = {r.pos: r.n for r in windows.distinct_so_far(df, ["k"], "seg", ["pos"], {"n": F.col("x")}).collect()}
    for r in shown.collect():
        names = sorted(set(pdf[(pdf.k == r.k) & (pdf.pos <= r.pos)].x.dropna()))
        assert r.seen == (names[:4] + ["<blank>"] * 4)[:4] and counts[r.pos] == len(names) and r.late == (r.pos > 300)


def test_exact_ranks_when_a_third_of_the_rows_are_one_value(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.choice(["a", "a", "b"], 6000), "id": np.arange(6000)})
    pdf["x"] = np.where(rng.random(6000) < 0.34, 5.0, rng.normal(5, 2, 6000).round(3))
    df = spark.createDataFrame(pdf)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    held = spark.conf.get(name)
    spark.conf.set(name, "false")
    sizes = [r["count"] for r in ordered.range_segments(df.select("x").distinct(), "x").groupBy("_seg").count().collect()]
    spark.conf.set(name, held)
    assert len(sizes) > 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    got = {r.g: r for r in aggregates.describe(df, ["g"], "x").collect()}
    for g, x in pdf.groupby("g")["x"]:
        assert np.allclose([got[g].q25, got[g].median, got[g].q75], np.quantile(x, [0.25, 0.5, 0.75])) and got[g].n == len(x)
    top = windows.top_share(df, ["g"], [F.desc("x"), "id"], 40.0).toPandas()
    for g, part in pdf.groupby("g"):
        want = part.sort_values(["x", "id"], ascending=[False, True]).head(int(len(part) * 0.4))
        assert top[top.g == g].sort_values("place").id.tolist() == want.id.tolist()
    words = spark.createDataFrame([(f"prefix-{i}",) for i in range(2000)] + [("prefix-1",)] * 900, "w string")
    ids = {r.w: r.id for r in aggregates.vocabulary(words, "w").collect()}
    assert ids == {w: i for i, w in enumerate(sorted(ids), 1)} and len(ids) == 2000
