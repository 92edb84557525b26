"""Whitening against numpy's eigendecomposition and exact integers."""

import math

import numpy as np
import pytest
from skirmish.llm import whitening
from skirmish.llm.queries import QUERIES


def test_rank_one_updates():
    rng = np.random.default_rng(0)
    for case in range(40):
        size = int(rng.integers(1, 12))
        q = np.linalg.qr(rng.normal(size=(size, size)))[0]
        values = np.sort(rng.choice([0.0, 1.0, 1.0, 1e-9, 5.0, 1e6], size) + (rng.random(size) if case % 2 else 0))
        vector = rng.normal(size=size) * rng.choice([1e-8, 1.0, 1e4]) if case % 7 else q[:, 0] * 3
        got, basis = whitening.rank_one(values, q, vector)
        want = q @ np.diag(values) @ q.T + np.outer(vector, vector)
        scale = max(1e-300, np.abs(want).max())
        assert np.allclose(basis.T @ basis, np.eye(size), atol=1e-11) and (np.diff(got) >= 0).all()
        assert np.abs(basis @ np.diag(got) @ basis.T - want).max() <= 1e-12 * scale * size


def test_spectra_of_parts_combine():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(900, 7)) @ rng.normal(size=(7, 7)) + 100
    rows[:, 3] = rows[:, 2]  # deflation
    whole = whitening.Spectrum.of_nothing(7)
    for part in np.split(rows, [1, 4, 300, 301]):
        one = whitening.Spectrum.of_nothing(7)
        for some in np.array_split(part, 3):
            one.add(some)
        whole.merge(whitening.Spectrum.from_bytes(one.count, one.to_bytes(), 7))
    centred = rows - rows.mean(0)
    want = np.linalg.eigvalsh(centred.T @ centred)
    assert whole.count == 900 and np.allclose(whole.mean, rows.mean(0))
    assert np.allclose(whole.values, want, atol=1e-9 * want[-1]) and np.allclose(whole.basis.T @ whole.basis, np.eye(7), atol=1e-10)


def check(rows, got, components=4):
    """``rows``: (id, vector) of the usable rows in float64."""
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = sum(values[i] > 1e-12 * values[0] for i in range(min(components, len(values))))
    white = (x - total / n) @ axes[:, :k] / np.sqrt(values[:k])
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == k * len(rows)
    for j in range(k):
        ours = np.array([found[i, j + 1][0].whitened for i, _ in rows])
        sign = np.sign(ours @ white[:, j])
        assert np.allclose(ours, sign * white[:, j], atol=1e-7)
        for (i, _), xs in zip(rows, x):
            r = found[i, j + 1][0]
            assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(xs, total))
            assert r.explained == pytest.approx(values[j] / values.sum(), rel=1e-9) and 0 <= r.identity_error < 1e-9


def test_op12(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = QUERIES["op12_whitening"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check([r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])], got.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, x string, n int")


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=3) * (3, 1, 0.2)]) for i in range(60)] + [(100, [0.5, -0.0, -1e-9])] * 3000
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 0.0]), (204, [float("inf"), 0.0, 0.0]),
           (205, [1.0, 2.0]), (206, [1e30, 0.0, 0.0])]
    check(good, whitening.whiten(frame(spark, good + odd)).collect())
    assert whitening.whiten(frame(spark, odd[:5])).count() == 0
    assert whitening.whiten(frame(spark, good).where("1 = 0")).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (None, [2.0, 4.0]), (2, [3.0, 6.0])])).collect()
    assert len(one) == 3 and all(r.component == 1 and r.explained == pytest.approx(1) for r in one)


def test_large_numbers_are_exact(spark):
    rows = [(i, [float(i * 3_000_000), 1.0]) for i in range(3)]
    check(rows, whitening.whiten(frame(spark, rows)).collect())


def test_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=5) * (9, 5, 3, 2, 1)]) for i in range(400)]
    check(rows, whitening.whiten(frame(spark, rows).repartition(13)).collect())
