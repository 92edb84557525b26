"""Small hand-made battle logs."""

from pyspark.sql import functions as F

from skirmish.functions import text as tx
from skirmish.operators import checks, events
from skirmish.plans import trajectories

LOG = """|player|p1|Alice||1500
|player|p2|Bob|
|teamsize|p1|1
|teamsize|p2|1
|gen|1
|tier|[Gen 1] OU
|rule|Species Clause: Limit one of each
|start
|switch|p1a: A|Aaa, L50|100/100
|switch|p2a: B|Bbb|100/100
|turn|1
|move|p1a: A|Tackle|p2a: B
|-damage|p2a: B|95/100y
|move|p2a: B|Hidden Power [Ice]|p1a: A
|-boost|p1a: A|atk|2
|turn|2
|-status|p2a: B|brn
|-curestatus|p2a: B|par
|turn|3
|-curestatus|p2a: B|brn
|turn|4
|-damage|p1a: A|40/100|[from] item: Life Orb|[of] p2a: B
|turn|5
|faint|p2a: B
|strange|x
|win|Alice"""


def lines(spark):
    df = spark.createDataFrame([("b1", LOG)], "battle_id string, log string")
    return events.log_lines(df).withColumn("seg", F.floor(F.col("pos") / 8))


def test_header_result_and_unknown(spark):
    h = events.headers(lines(spark)).first()
    assert (h["gen"], h["player1"], h["rating1"], h["rating2"], h["size1"], h["rules"]) == (
        1, "Alice", 1500, None, 1, ["Species Clause: Limit one of each"])
    assert events.results(lines(spark)).first()["winner"] == "p1"
    assert [r["type"] for r in events.unknown_types(lines(spark)).collect()] == ["strange"]
    assert checks.unfinished(lines(spark)).count() == 0
    assert checks.rule_violations(events.headers(lines(spark))).count() == 0


def test_clause_in_other_languages(spark):
    rules = ["Cláusula de Especie", "Artenklausel", "種族条項", "Sleep Clause"]
    df = spark.createDataFrame([(str(i), [r]) for i, r in enumerate(rules)], "battle_id string, rules array<string>")
    assert [r["battle_id"] for r in checks.rule_violations(df).collect()] == ["3"]


def test_status_cure_needs_the_same_status(spark):
    rows = lines(spark).where(F.col("type").isin("-status", "-curestatus"))
    out = events.statuses(rows, ["battle_id"], "seg", ["pos"], events.arg(1)).orderBy("pos").collect()
    assert [r["status"] for r in out] == ["brn", "brn", "nostatus"]


def test_annotations_and_hp(spark):
    row = lines(spark).where("type = '-damage'").orderBy(F.desc("pos")).select(
        tx.source_of(F.col("args"), "item").alias("i"), tx.entity_of(F.col("args")).alias("o"), tx.hp_fraction(events.arg(1)).alias("h")).first()
    assert (row["i"], row["o"], row["h"]) == ("Life Orb", "p2a: B", 0.4)
    first = lines(spark).where("type = '-damage'").orderBy("pos").select(tx.hp_fraction(events.arg(1)).alias("h")).first()
    assert first["h"] == 0.95


def test_steps_follow_the_reference_rules(spark):
    out = trajectories.replay_steps(lines(spark), "battle_id", "seg", ["pos"]).orderBy("pov", "turn").collect()
    one = [r for r in out if r["pov"] == 1]
    two = [r for r in out if r["pov"] == 2]
    assert [r["turn"] for r in one] == [0, 1, 2, 3, 4, 5]
    assert one[0]["action"] == "move:tackle" and two[0]["action"] == "move:hiddenpower"
    assert one[-1]["action"] == "hidden"
    assert [(r["own"], r["foe"]) for r in one] == [(r["foe"], r["own"]) for r in two]
    assert [r["own_hp"] for r in one] == [1.0, 1.0, 1.0, 1.0, 0.4, 0.4]
    assert [r["foe_left"] for r in one] == [6, 6, 6, 6, 6, 5]


def test_faint_without_answer(spark):
    rows = lines(spark).withColumn("side", tx.slot_side(events.arg(0)))
    t = F.col("type")
    bad = checks.unanswered_switches(rows, ["battle_id", "side"], "seg", ["pos"], t == "faint", t.isin("switch"))
    assert bad.count() == 1
