import math
from fractions import Fraction

import numpy as np
import pytest

from ranklane.llm import whitening


def plain_fit(vectors):
    """(n, sums, covariance, deviations) by exact fractions."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    left = [[n * r[i] - s[i] for i in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in left), n ** 3)) for j in range(d)] for i in range(d)])
    return n, s, cov, [sum(c * c for c in r) for r in left], np.array(left) / n


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.geomspace(1, 0.03, d) @ rng.normal(size=(d, d)) / d).astype(np.float32).astype(float)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(v), 0, 0.0) for i, v in rows],
                                 "vec_id long, embedding array<float>, n int, whitened double")


def test_rows_equal_a_plain_fit(spark):
    x = vectors(300, 12)
    n, _, cov, deviations, left = plain_fit(x.tolist())
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    found = {}
    for r in whitening.whiten(table(spark, list(enumerate(x.tolist()))).repartition(7)).collect():
        assert r.n == n and int(r.deviation) == deviations[r.vec_id] and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / cov.trace()) < 1e-12
        found[r.vec_id, r.component] = r.whitened
    assert len(found) == 300 * 8
    for k in range(8):
        want = left @ axes[:, k] / math.sqrt(values[k])
        got = np.array([found[i, k + 1] for i in range(300)])
        assert np.abs(np.sign(got @ want) * want - got).max() < 1e-8


def test_sums_do_not_depend_on_the_dealing(spark):
    df = table(spark, list(enumerate(vectors(200, 5, 3).tolist()))).select("vec_id", "embedding")
    df = df.selectExpr("vec_id", "cast(embedding as array<double>) as vector")
    n, totals = whitening.sums(df, 5)
    one = whitening.covariance(df.coalesce(1), n, totals)
    assert (whitening.covariance(df.repartition(6), *whitening.sums(df.repartition(3), 5)) == one).all()


@pytest.mark.parametrize("d,rank", [(1, 1), (2, 2), (9, 9), (16, 5), (40, 40)])
def test_factor_and_rotation(d, rank):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, rank)) * np.geomspace(1, 1e-3, rank)
    v = a @ a.T
    factor, order = whitening.pivoted_cholesky(v)
    assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-14)
    assert (np.abs(np.triu(factor, 1)) == 0).all() and (np.diff(np.diag(factor)) <= 0).all()
    values, units = whitening.components(v, d)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9, atol=1e-14 * values[0])
    assert np.abs(units.T @ units - np.eye(rank)).max() < 1e-13
    assert np.abs(v @ units - units * values).max() < 1e-13 * values[0]


def test_small_eigenvalues_keep_their_digits():
    """A graded matrix: the factor's rotation resolves what a plain solver loses."""
    d = np.diag([1.0, 1e-6, 1e-12])
    b = np.array([[1, 0.1, 0.1], [0.1, 1, 0.1], [0.1, 0.1, 1]])
    values, _ = whitening.components(d @ b @ d, 3)
    # determinant and leading minors of b fix the graded eigenvalues to first order
    assert values[0] == pytest.approx(1, rel=1e-11) and values[1] == pytest.approx(0.99e-12, rel=1e-9)


def test_rounds_meet_each_pair_once():
    for n in (1, 2, 5, 8):
        pairs = [(a, b) for p, q in whitening._rounds(n) for a, b in zip(p.tolist(), q.tolist())]
        assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]
        assert all(len(set(p) | set(q)) == 2 * len(p) for p, q in whitening._rounds(n))


def test_large_numbers_stay_exact():
    y = np.array([[1 << 40, -3], [7, 1 << 41]])
    assert whitening._products(y).tolist() == [[(1 << 80) + 49, -(3 << 40) + (7 << 41)], [-(3 << 40) + (7 << 41), 9 + (1 << 82)]]
    assert whitening._deviations(y, 10 ** 9, [5, -6]) == [((10 ** 9 << 40) - 5) ** 2 + (-3 * 10 ** 9 + 6) ** 2,
                                                         (7 * 10 ** 9 - 5) ** 2 + ((10 ** 9 << 41) + 6) ** 2]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.5, -2.0]), (1, [0.1, 0.5, -2.0]), (2, None), (3, []), (4, [1.0, None, 2.0]), (5, [nan, 0.0, 0.0]),
            (6, [0.0, -inf, 1.0]), (7, [1.0, 2.0]), (None, [0.3, -0.5, 1.0]), (9, [3e38, 0.0, -3e38])]
    found = whitening.whiten(table(spark, rows)).collect()
    assert sorted({str(r.vec_id) for r in found}) == ["1", "9", "None"] and {r.n for r in found} == {4}
    assert all(r.whitened == r.whitened and 0 <= r.explained <= 1 + 1e-12 for r in found)
    # equal vectors have no variance, and a lone one neither
    assert whitening.whiten(table(spark, rows[:2])).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, rows[2:6])).count() == 0
    flat = [(i, [float(i), 7.0]) for i in range(5)]
    got = whitening.whiten(table(spark, flat)).collect()
    assert [r.component for r in got] == [1] * 5 and got[0].explained == pytest.approx(1, abs=1e-12)
