"""Whitening against whole-number and plain arithmetic."""

import collections
from fractions import Fraction

import numpy as np
import pytest

from studyloom.llm import whitening as W

VECTORS = "vec_id long, embedding array<double>, x string, component string"
NAN = float("nan")


def rows():
    r = np.random.default_rng(4)
    base = r.normal(size=(300, 6)) @ r.normal(size=(6, 6)) + [0, 3, -50, 0, 1000, 0]
    out = [(i, v.tolist(), "a", "b") for i, v in enumerate(base)]
    out += [(1000 + i, out[7][1], None, None) for i in range(200)] + [(7, out[7][1], None, None), (None, out[3][1], None, None)]
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [NAN] * 6, [float("inf")] + [0.0] * 5, [1e300] + [0.0] * 5]
    return out + [(2000 + i, v, "a", "b") for i, v in enumerate(bad)]


def grid(v):
    return tuple(int(np.floor(64 * c)) + 1_000_000 for c in v)


def test_whitened(spark):
    got = W.whiten(spark.createDataFrame(rows(), VECTORS).repartition(5)).collect()
    kept = [(i, grid(v)) for i, v, *_ in rows() if i is None or i < 2000]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = [[Fraction(a) - Fraction(s, n) for a, s in zip(x, sums)] for x in fit]
    square = np.array([[float(sum(x[i] * x[j] for x in centred) / n) for j in range(6)] for i in range(6)])
    values = np.linalg.eigvalsh(square)[::-1]
    assert len(got) == 6 * len(kept) and {r.n for r in got} == {n}
    deviation = {x: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in fit}
    assert collections.Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == collections.Counter((i, deviation[x]) for i, x in kept)
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / square.trace(), rel=1e-9)
        assert r.identity_error < 1e-9
    by_id = collections.defaultdict(dict)
    for r in got:
        by_id[r.vec_id][r.component] = r.whitened
    whitened = np.array([[by_id[i][c] for c in range(1, 7)] for i in range(300)])
    # The projections of the vectors, scaled back, hold all of their distances from the mean.
    back = (whitened**2 * values).sum(axis=1)
    assert np.allclose(back, [deviation[grid(v)] / n / n for _, v, *_ in rows()[:300]], rtol=1e-9)
    vectors = np.linalg.lstsq(whitened * np.sqrt(values), np.array([[float(c) for c in np.array(grid(v)) - np.array([Fraction(s, n) for s in sums])] for _, v, *_ in rows()[:300]]), rcond=None)[0]
    assert np.allclose(vectors @ vectors.T, np.eye(6), atol=1e-9) and np.allclose(square @ vectors.T, vectors.T * values, atol=1e-6 * values[0])


def test_edges(spark):
    assert W.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0], "a", "b")] * 3, VECTORS)).count() == 0  # no variance, no component
    mixed = [(i, [float(i), 1.0], "a", "b") for i in range(4)] + [(i, [float(i % 3), float(i * i), 2.0 * i], "a", "b") for i in range(10, 20)]
    got = W.whiten(spark.createDataFrame(mixed, VECTORS)).collect()
    assert collections.Counter((r.n, r.component) for r in got) == {(4, 1): 4, (10, 1): 10, (10, 2): 10, (10, 3): 10}
    far = [(i, [2.0**45 * (i % 2), float(i)], "a", "b") for i in range(8)]
    assert {r.deviation for r in W.whiten(spark.createDataFrame(far, VECTORS)).collect()} == {None}


def test_more_components_than_asked(spark):
    r = np.random.default_rng(1)
    got = W.whiten(spark.createDataFrame([(i, v.tolist(), "a", "b") for i, v in enumerate(r.normal(size=(60, 24)))], VECTORS)).collect()
    assert {r.component for r in got} == set(range(1, 17)) and len(got) == 60 * 16


def test_sums_and_products_are_exact_to_double_double():
    x = np.random.default_rng(0).integers(-300, 300, (1300, 5)) + 1_000_000
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    high, low = W.outer_products(x.astype(float), W.divided((np.array(sums, float), np.zeros(5)), n))
    at = 0
    for i in range(5):
        for j in range(i, 5):
            want = sum((int(a) - Fraction(sums[i], n)) * (int(b) - Fraction(sums[j], n)) for a, b in zip(x[:, i], x[:, j]))
            assert abs(Fraction(high[at]) + Fraction(low[at]) - want) <= abs(want) / 2**85 + Fraction(1, 2**60)
            at += 1
    # 1 is lost beside 2**60 in doubles, not in pairs of them.
    total = W.summed((np.array([[2.0**60], [1.0], [-(2.0**60)], [1.0]]), np.zeros((4, 1))))
    assert total[0][0] + total[1][0] == 2
