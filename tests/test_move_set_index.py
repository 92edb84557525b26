"""Team ids by member and move set."""

from skirmish.operators import matching as mt


def test_move_sets_index_their_teams(spark):
    rows = [("a", ["x", "y"], 3), ("a", ["y", "x", "y"], 1), ("a", ["x"], 2), ("b", ["x", "y"], 1), ("a", ["x", "y"], 3),
            ("a", ["y", "x"], 1024), ("a", None, 5), ("b", [], 6)]
    got = mt.move_set_index(spark.createDataFrame(rows, "name string, moves array<string>, team long"), "name", "moves", "team").collect()
    assert sorted(((r.name, r.moves, r.block, r.ids) for r in got), key=repr) == sorted([
        ("a", ["x", "y"], 0, [1, 3]), ("a", ["x", "y"], 1, [1024]), ("a", ["x"], 0, [2]), ("b", ["x", "y"], 0, [1]),
        ("a", None, 0, [5]), ("b", [], 0, [6])], key=repr)
