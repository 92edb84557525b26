"""Nearest neighbours of vectors that lie far from the crowd."""

import numpy as np
from pyspark.sql import functions as F
from skirmish.llm import neighbours


def test_isolated_queries_are_whole(spark):
    """Five tight clusters, where one probe is enough for nearly all, and some vectors apart from them."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 32))
    x = np.concatenate([rng.standard_normal((60, 32)), np.repeat(centres, 800, axis=0) + 0.01 * rng.standard_normal((4000, 32))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    units = x / np.linalg.norm(x, axis=1)[:, None]
    for block in (16, 2048):
        got = {}
        for r in neighbours.nearest(df, (F.col("vec_id") < 60) | (F.col("vec_id") % 100 == 0), block=block).collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert set(got) == {*range(60), *range(100, 4060, 100)} and all(len(v) == 5 for v in got.values())
        hits = 0
        for q in range(60):
            scores = units @ units[q]
            scores[q] = -2
            hits += len(set(got[q]) & set(np.argsort(-scores)[:5].tolist()))
        assert hits >= 0.95 * 5 * 60
    few = neighbours.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0)
    assert few.count() == 3


def test_probes_answer_the_given_queries(spark, monkeypatch):
    """No query of the given tables is compared with all vectors."""
    asked = []
    scanned = neighbours._scanned
    monkeypatch.setattr(neighbours, "_scanned", lambda classes, *rest: asked.extend(classes) or scanned(classes, *rest))
    for sf, least in (("sf0.01", 0.9), ("sf0.1", 0.9)):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        rows = df.collect()
        ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
        units, hits, total = x / np.linalg.norm(x, axis=1)[:, None], 0, 0
        got = {}
        for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        for q in np.flatnonzero(ids % 50 == 0):
            scores = units @ units[q]
            scores[q] = -2
            want = ids[np.lexsort((ids, -scores))[:5]]
            hits, total = hits + len(set(got[ids[q]]) & set(want.tolist())), total + 5
        assert hits >= least * total, (sf, hits / total)
        assert len(asked) <= 0.05 * len(got)
