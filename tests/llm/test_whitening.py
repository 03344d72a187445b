"""Whitening against NumPy's eigendecomposition of the exact covariance."""

import numpy as np
import pytest

from gridcast.llm import whitening


def scatter(rows):
    away = rows - rows.mean(0)
    return away.T @ away


def rebuilt(s):
    return s.vectors @ np.diag(s.values) @ s.vectors.T


@pytest.mark.parametrize("block", [1, 7, 4096])
@pytest.mark.parametrize("size", [1, 2, 5, 24])
def test_updates_equal_the_scatter(block, size):
    rng = np.random.default_rng(size)
    rows = np.round(rng.normal(size=(150, size)) * np.linspace(1, 40, size))
    s = whitening.Spectrum(size)
    for begin in range(0, len(rows), block):
        s.block(rows[begin : begin + block])
    assert s.n == 150 and np.allclose(s.mean, rows.mean(0), atol=1e-12)
    assert np.abs(rebuilt(s) - scatter(rows)).max() <= 1e-12 * np.abs(scatter(rows)).max()
    assert np.abs(s.vectors.T @ s.vectors - np.eye(size)).max() < 1e-12


def test_deflation_of_repeats_and_flat_directions():
    rng = np.random.default_rng(3)
    flat = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 9))
    rows = np.concatenate([flat, flat, np.zeros((6, 9)), np.eye(9), np.eye(9) * -1])
    one, two = whitening.Spectrum(9), whitening.Spectrum(9)
    for r in rows[:60]:
        one.block(r[None])
    for r in rows[60:]:
        two.block(r[None])
    one.join(whitening.Spectrum.unpack(two.pack(), 9))
    assert np.abs(rebuilt(one) - scatter(rows)).max() < 1e-11 * np.abs(scatter(rows)).max()
    assert np.abs(one.vectors.T @ one.vectors - np.eye(9)).max() < 1e-12


def check(found, rows, ids, k):
    """Rows of one length against the exact covariance of their distinct whole numbers."""
    x = np.floor(64 * rows.astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    away = (fit * n - sums) / n
    values, axes = np.linalg.eigh(away.T @ away / n)
    trace, values, axes = values.sum(), values[::-1][:k], axes[:, ::-1][:, :k]
    want = ((x * n - sums) / n) @ axes / np.sqrt(values)
    by = {(r.vec_id, r.component): r for r in found}
    assert set(by) == {(i, c) for i in ids for c in range(1, k + 1)}
    got = np.array([[by[i, c].whitened for c in range(1, k + 1)] for i in ids])
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-9
    for i, row in zip(ids, x.tolist(), strict=True):
        r = by[i, 1]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True))
        assert r.identity_error < 1e-10
    assert np.allclose([by[ids[0], c].explained for c in range(1, k + 1)], values / trace, rtol=1e-10)


def test_whitening_of_a_table(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(300, 20)).astype(np.float32) * np.linspace(0.2, 3, 20, dtype=np.float32)
    rows[250:] = rows[7]
    other = rng.normal(size=(60, 3)).astype(np.float32)
    table = [(i, [float(x) for x in v], "a", "b") for i, v in enumerate(rows)] + [(1000 + i, [float(x) for x in v], "a", "b") for i, v in enumerate(other)]
    bad = [(2001, None, "", ""), (2002, [], "", ""), (2003, [1.0, None] * 10, "", ""), (2004, [float("nan")] * 20, "", ""), (2005, [float("inf")] * 20, "", "")]
    frame = spark.createDataFrame(table + bad, "vec_id long, embedding array<float>, size string, component string").repartition(5)
    models = whitening.learn(frame)
    found = whitening.whiten(frame, models).collect()
    check([r for r in found if r.vec_id < 1000], rows, list(range(300)), 16)
    check([r for r in found if r.vec_id >= 1000], other, [1000 + i for i in range(60)], 3)
    plain = whitening.learn(frame, block=1)
    assert np.allclose(plain[20].values, models[20].values, rtol=1e-12)


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    empty = spark.createDataFrame([], kind)
    assert whitening.learn(empty) == {} and whitening.whiten(empty, {}).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], kind)
    models = whitening.learn(one)
    assert models[2].n == 1 and len(models[2].values) == 0 and whitening.whiten(one, models).collect() == []
    wide = spark.createDataFrame([(1, [1e200, 0.0]), (None, [-1e200, 0.0]), (2, [1e-200, 1.0])], kind)
    found = whitening.whiten(wide, whitening.learn(wide)).collect()
    assert {r.vec_id for r in found} == {1, None, 2} and all(np.isfinite(r.whitened) for r in found)
    assert {(r.vec_id, r.deviation) for r in found} == {(1, None), (None, None), (2, (3 * 64 - 64) ** 2)}
