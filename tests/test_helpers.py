"""Helpers and message forms that no query reaches, on small hand-made rows."""

import random

from pyspark.sql import functions as F

from skirmish.functions import encoding, records
from skirmish.operators import events, filters, matching, models, sequences
from skirmish.sources import results, usage
from skirmish.streaming import streams


def one(spark, **columns):
    df = spark.range(1).select(*[c.alias(n) for n, c in columns.items()])
    return df.first()


def strings(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def test_small_column_helpers(spark):
    row = one(spark, a=encoding.effect_token(F.lit("Leech Seed")), b=encoding.effect_token(F.lit(None).cast("string")),
              c=sequences.detokenise(F.array(F.lit(1), F.lit(9)), {1: "x"}), d=records.default_moves(strings("m"), F.lit(2)),
              e=records.gap_fill(F.lit(None).cast("string"), F.lit("y")), f=filters.one_per_clause(strings("A b", "ab")),
              g=filters.one_per_clause(strings("p", "q"), {"p": "1", "q": "1"}), h=filters.one_per_clause(strings("p", "q")))
    assert row.a == "leechseed" and row.b == "noeffect" and row.c == ["x", "<unk>"]
    assert row.d == ["m", None, records.NONE, records.NONE] and row.e == "y"
    assert not row.f and not row.g and row.h


def test_checks_projection_and_appended_results(spark, tmp_path):
    rows = spark.createDataFrame([("a", "checks", "b", 0.5), ("a", "moves", "m", 0.5)], "entity string, field string, key string, share double")
    assert [tuple(r) for r in usage.checks_projection(rows).collect()] == [("a", "b", 0.5)]
    for i in range(2):
        results.append_results(spark.createDataFrame([(i,)], "id long"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_top_team(spark):
    pool = spark.createDataFrame([(1, "a", 5.0), (2, "a", 7.0), (3, "b", 6.0), (4, "c", 1.0)], "m long, c string, s double")
    assert [r.m for r in models.top_team(pool, "m", "c", "s", 2).collect()] == [2, 3]


def test_each_available(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = streams.file_stream(spark, str(tmp_path / "in"), spark.range(1).schema)
    streams.each_available(stream, str(tmp_path / "c"), lambda batch, i: seen.append(batch.count()))
    assert seen == [5]


def test_every_boost_message(spark):
    """Stages against a plain simulation, long enough for several blocks."""
    rng = random.Random(6)
    kinds = ["-boost", "-unboost", "-setboost", "-swapboost", "-clearboost", "-copyboost", "-invertboost", "-clearpositiveboost",
             "-clearnegativeboost", "-restoreboost", "-clearallboost", "switch", "drag", "move"]
    rows, want = [], {}
    for key in (1, 2):
        state = {"p1": 0, "p2": 0}
        for at in range(300 if key == 1 else 20000 // 50):
            kind, side, n = rng.choice(kinds), rng.choice(["p1", "p2"]), rng.randrange(1, 4)
            foe = "p2" if side == "p1" else "p1"
            if kind == "-boost":
                state[side] = min(6, state[side] + n)
            elif kind == "-unboost":
                state[side] = max(-6, state[side] - n)
            elif kind == "-setboost":
                state[side] = n
            elif kind == "-swapboost":
                state["p1"], state["p2"] = state["p2"], state["p1"]
            elif kind in ("-clearboost", "switch", "drag"):
                state[side] = 0
            elif kind == "-copyboost":
                state[side] = state[foe]
            elif kind == "-invertboost":
                state[side] = -state[side]
            elif kind == "-clearpositiveboost":
                state[side] = min(0, state[side])
            elif kind in ("-clearnegativeboost", "-restoreboost"):
                state[side] = max(0, state[side])
            elif kind == "-clearallboost":
                state = {"p1": 0, "p2": 0}
            rows.append((key, at // 7, at, kind, side, n))
            want[key, at] = (state["p1"], state["p2"])
    df = spark.createDataFrame(rows, "key long, seg long, at long, type string, side string, amount int")
    got = events.boost_stages(df, ["key"], "seg", ["at"], F.col("side")).collect()
    assert {(r.key, r["at"]): (r.stage1, r.stage2) for r in got} == want


def test_team_cure_and_swapped_sides(spark):
    rows = [(1, 1, "-status", "p1", "A", "par"), (1, 2, "-status", "p1", "B", "brn"), (1, 3, "-status", "p2", "A", "slp"),
            (1, 4, "-cureteam", "p1", "B", ""), (1, 5, "-curestatus", "p1", "A", "par"), (1, 6, "-status", "p1", "A", "frz"),
            (1, 7, "-curestatus", "p2", "A", "par")]
    df = spark.createDataFrame([(*r, r[1] // 3) for r in rows], "battle long, at long, type string, side string, entity string, v string, seg long")
    got = events.statuses(df, ["battle", "side", "entity"], "seg", ["at"], F.col("v")).orderBy("at").collect()
    assert [r.status for r in got] == ["par", "brn", "slp", "nostatus", "nostatus", "frz", "slp"]
    swaps = [(1, 1, "-sidestart", "p1"), (1, 2, "-swapsideconditions", "p1"), (1, 3, "-sideend", "p2"), (1, 4, "-swapsideconditions", "p2"),
             (1, 5, "-sidestart", "p2")]
    df = spark.createDataFrame([(*r, r[1] // 2) for r in swaps], "battle long, at long, type string, side string, seg long")
    got = events.home_side(df, ["battle"], "seg", ["at"], F.col("side")).orderBy("at").collect()
    assert [r.home for r in got] == ["p1", "p2", "p1", "p2", "p2"]


def test_one_hot_battle_is_split(spark):
    """A battle with a third of all rows: no segment holds over 2 % of the rows."""
    from skirmish.queries import battle

    rows = battle.log(spark, "/root/testdata/sf0.01").select("battle_id", "seg")
    total = rows.count()
    hot = rows.withColumn("battle_id", F.when(F.rand(1) < 1 / 3, F.lit(-1)).otherwise(F.col("battle_id")))
    assert hot.groupBy("battle_id", "seg").count().agg(F.max("count")).first()[0] < 0.02 * total
