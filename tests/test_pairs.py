"""Most frequent pairs, in rows and in blocks, against plain Python."""

import collections
import itertools
import random

from skirmish.operators import aggregates as agg


def test_top_pairs_of_small_and_large_teams(spark, monkeypatch):
    monkeypatch.setattr(agg, "TEAM", 4)
    monkeypatch.setattr(agg, "TASK_ROWS", 10)
    rng = random.Random(3)
    rows = [(t, rng.randrange(12)) for t in range(30) for _ in range(rng.randint(1, 9))] + [(None, 1), (None, 2), (5, None)]
    teams = collections.defaultdict(set)
    for t, m in rows:
        if t is not None and m is not None:
            teams[t].add(m)
    counts = collections.Counter(p for ms in teams.values() for p in itertools.combinations(sorted(ms), 2))
    want = sorted(((-n, a, b) for (a, b), n in counts.items()))[:20]
    df = agg.top_pairs(spark.createDataFrame(rows, "team int, member int"), "team", "member", 20)
    assert [(-r.n, r.a, r.b) for r in df.collect()] == want
    # As many tasks as the rows ask for.
    assert "RepartitionByExpression [a" in (plan := df._jdf.queryExecution().optimizedPlan().toString()) and f", {-(-len(rows) // 10)}" in plan
