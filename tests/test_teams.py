"""Teams of orders: one shuffle of their lines; candidates under each of their tokens are not broadcast."""

from pyspark.sql import functions as F

from skirmish.operators import containment as ct
from skirmish.queries import joins


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(spark, path, rows):
    spark.createDataFrame(rows, """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double,
        l_returnflag string, l_linestatus string""").coalesce(1).write.parquet(f"{path}/lineitem.parquet")


ROWS = [
    (10, 3, 1, 2, 5.0, 0.0, "N", "O"),  # leads: first line
    (10, 4, 2, 3, 5.0, 0.0, "R", "O"),
    (10, 4, 22, 4, 5.0, 0.0, "A", "F"),  # the same name again
    (20, 4, 2, 3, 5.0, 0.0, "R", "O"),
    (20, 3, 1, 2, 30.0, 0.0, "N", "O"),
    (30, 4, 2, 3, 5.0, 0.0, "R", "O"),  # the team of 10 in another order of lines
    (30, 3, 1, 2, 5.0, 0.0, "N", "O"),
    (None, 3, None, 1, 5.0, 0.0, "N", "O"),  # no name leads, no order
    (None, 4, 2, None, 5.0, 0.0, None, "F"),
    (40, 3, 5, 1, 5.0, 0.0, 'q"\\,[', "O"),
]


def test_distinct_teams(spark, tmp_path):
    _lines(spark, str(tmp_path), ROWS)
    known = {(r.key, tuple(t.replace("\x01", ".") for t in r.tokens)): r.copies for r in joins.known_teams(spark, str(tmp_path)).collect()}
    two = ("2", "2.item=R", "2.moves=a1")
    assert known == {("1", two): 2, ("1", (".nature=bold", *two)): 1, ("2", (".ability=F", ".moves=a1")): 1, ("5", ('.item=q"\\,[',)): 1}


def test_lines_are_shuffled_once(spark, tmp_path):
    _lines(spark, str(tmp_path), ROWS * 3)
    for teams in (joins.teams, joins.different_teams):
        plan = _plan(teams(spark, str(tmp_path)))
        assert len([line for line in plan.splitlines() if "Exchange hashpartitioning(team_id" in line]) == 1


def test_team_of_many_batches(spark, tmp_path):
    """One order of 30,000 lines, cut by batches, beside small ones."""
    _lines(spark, str(tmp_path), [(0, 3, i % 20, 1 + i // 20, 5.0, 0.0, "N", "O") for i in range(30000)] + [(5 * i, 3, 7, 1, 5.0, 0.0, "N", "O") for i in range(1, 500)])
    got = sorted((r.lead.name, len(r.reserve), r.n) for r in joins.different_teams(spark, str(tmp_path)).collect())
    assert got == [(0, 19, 1), (7, 0, 499)]


def test_exploded_candidates_are_not_broadcast(spark, tmp_path):
    known = spark.range(200).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("string").alias("key"),
                                    F.array(F.concat(F.lit("a"), F.col("id") % 5), F.concat(F.lit("b"), F.col("id") % 7)).alias("tokens"), F.lit(1).cast("long").alias("copies"))
    known.write.parquet(f"{tmp_path}/known")
    known = spark.read.parquet(f"{tmp_path}/known")
    for df in (ct.contained(known, known, F.col("id"), F.col("id")), ct.contained(known, known.where("copies = 1"), F.col("id"), F.col("id")), ct.leaves(known)):
        plan = _plan(df)
        meets = [line for line in plan.splitlines() if "Join [code" in line]
        assert meets and all("SortMergeJoin" in line for line in meets if "block" in line) and any("block" in line for line in meets)
    pairs = {(int(r.record), int(r.candidate)) for r in ct.contained(known, known, F.col("id"), F.col("id")).collect()}
    assert pairs == {(a, b) for a in range(200) for b in range(200) if (a - b) % 105 == 0}
