"""Rows that an explode multiplies are not broadcast: Spark sizes them like the rows before the explode."""

from pyspark.sql import functions as F

from skirmish.llm import simhash


def test_exploded_fingerprints_are_not_broadcast(spark, monkeypatch):
    plans, materialise = [], simhash.materialise
    shown = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(simhash, "materialise", lambda df, label: shown(df) or materialise(df, label))
    fps = spark.range(300).select(F.when(F.col("id") < 40, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").cast("int")))
                                  .otherwise(F.xxhash64("id")).alias("fp"))
    out = simhash.links(fps, 4, compared=8)
    shown(out)
    assert len(plans) == 2
    for plan in plans:
        assert "Generate explode" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {r.a for r in out.collect()} | {r.b for r in out.collect()} >= {1 << i for i in range(40)}
