"""Whitening against a direct eigendecomposition and exact integer sums."""

from __future__ import annotations

import math

import numpy as np
import pytest

from crestline.llm import whitening
from crestline.llm.whitening import Spectrum, rank_one


def updated(rng, d, v):
    basis = np.linalg.qr(rng.normal(size=(len(d), len(d))))[0]
    values, vectors = rank_one(d, basis, v)
    whole = basis @ np.diag(d) @ basis.T + np.outer(v, v)
    scale = max(1e-300, np.abs(whole).max())
    assert np.all(np.diff(values) >= 0)
    assert np.abs(vectors.T @ vectors - np.eye(len(d))).max() < 1e-12
    assert np.abs(vectors @ np.diag(values) @ vectors.T - whole).max() < 1e-12 * scale
    assert np.allclose(values, np.linalg.eigvalsh(whole), atol=1e-12 * scale)


@pytest.mark.parametrize("size", [1, 2, 3, 8, 40])
def test_rank_one_updates(size):
    rng = np.random.default_rng(size)
    for trial in range(60):
        d = np.sort(rng.exponential(1, size) * 10.0 ** rng.integers(-8, 8, size))
        if trial % 3 == 1:
            d = np.sort(rng.integers(0, 3, size).astype(float))  # shared eigenvalues
        if trial % 5 == 2:
            d = d[0] * (1 + np.arange(size) * 1e-15)
        v = rng.normal(size=size) * 10.0 ** rng.integers(-6, 6)
        if trial % 4 == 3:
            v = v * (rng.random(size) < 0.3)
        updated(rng, d, v)
    updated(rng, np.zeros(size), np.zeros(size))


def test_states_of_parts_combine():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)))
    parts = []
    for some in (x[:1], x[1:150], x[150:152], x[152:]):
        own = Spectrum.empty(12)
        for row in some:
            own.add(row)
        parts.append(Spectrum.unpacked(own.packed(), 12))
    whole = parts[0].join(parts[1]).join(parts[2]).join(parts[3])
    centred = x - x.mean(0)
    assert whole.count == 300 and np.allclose(whole.mean, x.mean(0))
    assert np.allclose(whole.basis @ np.diag(whole.values) @ whole.basis.T, centred.T @ centred, rtol=1e-10)


def direct(vectors):
    """(n, S, eigenvalues, eigenvectors, trace) of the distinct whole vectors."""
    distinct = sorted(set(map(tuple, vectors)))
    x = np.array(distinct, np.int64)
    n, sums = len(distinct), [sum(v[k] for v in distinct) for k in range(len(distinct[0]))]
    centred = x - np.array(sums) / n
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    return n, sums, values[::-1], basis[:, ::-1], np.trace(cov)


def check(spark, rows, rounds=None):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, n int").repartition(5)
    got = whitening.whiten(frame).collect()
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max(len(v) for _, v in kept)
    kept = [(i, v + (0,) * (size - len(v))) for i, v in kept]
    n, sums, values, basis, trace = direct([v for _, v in kept])
    by_component = {}
    assert len(got) == len(kept) * min(4, size)
    expected = {}
    for i, v in kept:
        expected.setdefault(i, []).append(v)
    for r in got:
        by_component.setdefault(r.component, []).append(r)
        deviation = {sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in expected[r.vec_id]}
        assert r.n == n and r.deviation in deviation
    for component, some in by_component.items():
        k = component - 1
        if values[k] <= 1e-9 * max(trace, 1e-300):
            assert all(r.whitened == 0 and r.explained == 0 for r in some)
            continue
        assert all(abs(r.explained - values[k] / trace) < 1e-9 for r in some)
        assert all(r.identity_error < 1e-9 for r in some)
        one = {i: v for i, v in kept if len(expected[i]) == 1}
        mine = np.array([r.whitened for r in some if r.vec_id in one])
        theirs = np.array([(np.array(one[r.vec_id]) - np.array(sums) / n) @ basis[:, k] / np.sqrt(values[k]) for r in some if r.vec_id in one])
        assert np.abs(mine - np.sign(mine @ theirs) * theirs).max() < 1e-8


def row(i, v):
    return (i, v, 1, "x", 2)


def test_against_direct_eigendecomposition(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 20)  # many states, several rounds
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(260, 9)) * np.array([3, 2, 1.5, 1, 0.5, 0.2, 0.1, 0.1, 0.01])).tolist()
    rows = [row(i, v) for i, v in enumerate(x)] + [row(500 + k, x[0]) for k in range(90)]  # one hot vector
    rows += [row(900, None), row(901, [float("nan")] * 9), row(902, [float("inf")] + [0.0] * 8), row(903, [None] + [1.0] * 8), row(904, [-float("inf")] * 9)]
    rows += [row(905, [-0.0] * 9), row(906, [1.0, 2.0]), row(906, [1.0, 2.0]), row(None, x[5])]
    check(spark, rows)


@pytest.mark.parametrize("vectors", [[[1.0, 2.0, 3.0]] * 3, [[1.0], [2.0]], [[0.5, 0.0, 1.0, 4.0, 2.0], [0.25, 1.0, 0.0, 4.0, 2.0]], [[]]])
def test_few_and_flat_vectors(spark, vectors):
    check(spark, [row(i, v) for i, v in enumerate(vectors)])


def test_empty_tables_and_huge_entries(spark):
    form = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], form)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [float("nan")])], form)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 0.0])], form)).collect()
    assert len(got) == 6 and all(math.isfinite(r.whitened) for r in got) and {r.deviation for r in got if r.vec_id == 1} == {None}
