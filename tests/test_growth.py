"""What is written, shuffled and held grows no faster than the input."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skirmish.operators import aggregates as agg, matching as mt, models, sampling as sp
from skirmish.queries import joins, stats

SF = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


@pytest.fixture
def written(monkeypatch):
    """Label -> rows of everything the models write."""
    rows = {}

    def record(df, label, *args):
        rows[label] = df.count()
        return plain(df, label, *args)

    plain = models.materialise
    monkeypatch.setattr(models, "materialise", record)
    return rows


def repeated(spark):
    rows = [(i, [i % 3, 3 + i % 2], [5 + i % 2, 7], int(i % 12 < 7)) for i in range(1200)]
    return spark.createDataFrame(rows, "id long, a array<int>, b array<int>, y int")


def test_distinct_teams_takes_as_many_tasks_as_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(agg, "TASK_ROWS", 10)
    df = spark.createDataFrame([(1, t, str(m % (t % 7 + 1))) for t in range(60) for m in range(5)] + [(1, None, "1"), (1, 99, None)], "c int, t int, m string")
    out = agg.distinct_teams(df, ["c"], "t", F.col("m"))
    assert [tuple(r) for r in out.collect()] == [(1, 62, 7)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count(f"], {-(-302 // 10)}") == 2


def test_swaps_stay_in_the_team_row(spark):
    pool = spark.createDataFrame([(i, i % 9, float(i)) for i in range(30)], "m long, c long, s double")
    teams = spark.createDataFrame([(1, [0, 10, 20])], "t int, ms array<long>")
    out = models.best_swaps(teams, "t", "ms", pool, "m", "c", "s")
    assert [(r.out, r["in"], r.gain) for r in out.collect()] == [(0, 27, 27.0)]
    assert "max_by" not in out._jdf.queryExecution().optimizedPlan().toString()
def test_rosters_leave_details_out(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(joins, "materialise", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    got = {r.team_id: r.names for r in joins.rosters(spark, SF).collect()}
    assert " AS item#" not in plans[0] and "Window" not in plans[0]
    want = {r.team_id: [str(r.lead["name"]), *[str(m["name"]) for m in r.reserve]] for r in joins.teams(spark, SF).collect()}
    assert got == want


def test_teammates_meet_without_another_shuffle(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "team int, name string")
    shares = mt.teammate_shares(rows, "team", "name")
    assert {(r.name, r.mate): r.share for r in shares.collect()} == {("a", "b"): .5, ("b", "a"): 1.}
    assert shares._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [team") == 3


def test_equal_examples_are_fitted_once(spark, written):
    weights, metrics, _ = models.fit_baseline(repeated(spark), "id", "a", "b", "y", max_iter=30)
    assert written["examples"] <= 24 and weights.count() == 8
    assert metrics.first()["log_loss"] > 0


def test_vectors_are_made_once_for_all_penalties(spark, written):
    weights, tuning = models.fit_interaction(repeated(spark), "id", "a", "b", "y", c_values=(0.1, 1.0), max_iter=20)
    assert tuning.count() == 2 and weights.where("kind = 'main'").count() == 8
    assert written["train-vectors"] == written["train"] <= 48


def test_copies_weigh_as_much_as_rows(spark):
    rows = spark.createDataFrame([(1, .9), (1, .9), (1, .9), (0, .3), (0, .8), (0, .8)], "y int, p double")
    folded = spark.createDataFrame([(1, .9, 3), (0, .3, 1), (0, .8, 2)], "y int, p double, copies int")
    want, got = agg.binary_metrics(rows, [], F.col("y"), F.col("p")).first(), agg.binary_metrics(
        folded, [], F.col("y"), F.col("p"), copies=F.col("copies")).first()
    assert [round(v, 12) for v in want] == [round(v, 12) for v in got]
    pairs = agg.top_pairs(spark.createDataFrame([(1, 3, "x"), (1, 3, "y"), (2, 2, "x"), (2, 2, "y"), (2, 2, "z")], "t int, n int, m string"), "t", "m", 5, "n")
    assert [(r.a, r.b, r.n) for r in pairs.collect()] == [("x", "y", 5), ("x", "z", 2), ("y", "z", 2)]


def test_presence_folds_equal_samples(spark, written):
    """Repeated keys share their terms and samples without a key have none, as when each was a row."""
    rows = [(i, [i % 3, 3 + i % 2], int(i % 12 < 7), "f") for i in range(600)] + [(7, [0, 1], 1, "f"), (None, [1, 2], 0, "f")]
    s = spark.createDataFrame(rows, "id long, m array<int>, y int, fmt string")
    got = {r.feature: r.odds for r in models.fit_presence(s, "id", "m", "y", 2, 2, "fmt").collect()}
    assert written["sample-kinds"] <= 16 and written["presence"] <= 17
    assert {"member:0", "member:4", "format:f"} <= set(got) and sum(f.startswith("pair:") for f in got) == 2


def test_usage_is_shuffled_once(spark):
    usage, counts = stats.usage_tables(spark, SF)
    assert usage.columns == [*stats.UNIT, "field", "key", "share"]
    assert exchanges(usage) == 1 and exchanges(stats.counted_usage(spark, SF)[0]) == 1


def test_thompson_tasks_follow_the_lines(spark, monkeypatch):
    monkeypatch.setattr(agg, "TASK_ROWS", 500)
    plan = entry.queries()["R12_thompson_choice"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    parts = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)
    assert re.search(rf"RepartitionByExpression \[l_orderkey#\d+L\], {parts}", plan)


def test_few_options_do_not_shuffle_members(spark):
    options = sp.option_lists(spark.createDataFrame([("N1", "items", "x", .5), ("N1", "items", "y", .5), ("N1", "moves", "m", 1.)],
                                                    "entity string, field string, key string, share double"), "entity")
    rows = spark.createDataFrame([(i, f"N{i % 2}", None, []) for i in range(50)], "id long, entity string, item string, moves array<string>")
    out = sp.complete_members(rows, ["id"], "entity", options, {"item": "items"}, "moves", "s")
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString() and exchanges(out) == 1
    got = {r.id: (r.item, r.moves) for r in out.collect()}
    assert set(out.columns) == set(rows.columns) and got[0] == (None, []) and got[1][0] in "xy" and got[1][1] == ["m"]


def test_draws_do_not_sort_options(spark):
    options = sp.option_lists(spark.createDataFrame([("N1", "teammates", "N2", .5), ("N2", "teammates", "N1", .5)],
                                                    "entity string, field string, key string, share double"), "entity")
    rows = spark.createDataFrame([(1, ["N1"])], "id long, members array<string>")
    out = sp.complete_roster(rows, "id", "members", options, "entity", 2, "s")
    assert "array_sort" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.collect()[0].members == ["N1", "N2"]


@pytest.fixture
def retrieval_plans(monkeypatch):
    """Label -> executed plan of everything that retrieval writes."""
    plans = {}

    def record(df, label, *args):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, label, *args)

    plain = mt.materialise
    monkeypatch.setattr(mt, "materialise", record)
    return plans


def retrieval_rows(spark, kind="long"):
    """Teams 0 to 39 with names t to t + 7 and a move each; requests ask for three names, the last for one that no team has too."""
    members = [(t, t + i, [(t + i) % 3]) for t in range(40) for i in range(8)]
    wanted = [(0, 5, 0, [2]), (0, 7, 1, [1]), (0, 9, 2, [0]), (1, 3, 0, [0]), (1, 10, 1, [1]), (1, 45, 2, [0]), (2, 99, 0, [1])]
    return (spark.createDataFrame(wanted, f"req long, name {kind}, position int, wanted_moves array<int>"),
            spark.createDataFrame(members, "team long, name long, moves array<int>"))


RETRIEVED = {(0, 2, 3, 1.0), (1, 3, 2, round(2 / 3, 6))}


def test_choices_nobody_asks_for_are_not_made(spark):
    teams = spark.createDataFrame([(t, list(range(t, t + 8))) for t in range(40)], "team long, names array<long>")
    code = F.lit(0).cast("long")
    begun = [code := mt._link(code, F.lit(n).cast("long")) for n in (5, 7, 9)]
    held = mt._may_hold(spark.range(1).select(F.explode(F.array(*begun)).alias("c")), "c")
    got = mt._asked_choices(teams, 3, "names", held).collect()
    assert {(t, (5, 7, 9)) for t in (2, 3, 4, 5)} <= {(r.team, tuple(r.names[i] for i in r._picked)) for r in got}
    assert len(got) < 20  # of 40 * 56


def test_retrieval_shuffles_no_choices_before_they_are_tested(spark, retrieval_plans):
    wanted, members = retrieval_rows(spark)
    out = mt.best_retrieval(wanted, members, "req", "team", "name")
    assert {(r.req, r.team, r.matched, round(r.ratio, 6)) for r in out.collect()} == RETRIEVED
    assert "getbit" in retrieval_plans["retrieved-3"] and "LeftSemi" not in retrieval_plans["retrieved-3"]
    assert "getbit" in retrieval_plans["teams-asked"] and "LeftSemi" not in retrieval_plans["teams-asked"]


def test_full_filters_and_other_types_lose_no_team(spark, monkeypatch):
    monkeypatch.setattr(mt, "_link", lambda code, value: F.lit(0).cast("long"))  # every code is the same, all pass
    out = mt.best_retrieval(*retrieval_rows(spark), "req", "team", "name")
    assert {(r.req, r.team, r.matched, round(r.ratio, 6)) for r in out.collect()} == RETRIEVED
    monkeypatch.undo()
    out = mt.best_retrieval(*retrieval_rows(spark, "int"), "req", "team", "name")
    assert {(r.req, r.team, r.matched, round(r.ratio, 6)) for r in out.collect()} == RETRIEVED


def test_retrieval_stops_when_all_are_answered(spark, retrieval_plans):
    wanted, members = retrieval_rows(spark)
    out = mt.best_retrieval(wanted.where("req = 0"), members, "req", "team", "name")
    assert [(r.team, r.matched) for r in out.collect()] == [(2, 3)]
    assert "retrieved-3" in retrieval_plans and "retrieved-2" not in retrieval_plans


def test_retrieval_shuffles_lines_once(spark, retrieval_plans):
    entry.queries()["J12_best_retrieval"](spark, SF)
    assert len(re.findall(r"Exchange hashpartitioning", retrieval_plans["teams-asked"])) == 1
