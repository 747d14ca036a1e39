"""Whitening against numpy's eigenvectors, and the solver on hard matrices."""

import numpy as np
import pytest

from stationmine.llm import whitening


def hard(kind, d, rng):
    if kind == "random":
        return rng.standard_normal((3 * d, d))
    if kind == "graded":
        return rng.standard_normal((3 * d, d)) * 10.0 ** -np.linspace(0, 9, d)
    if kind == "equal":
        return np.vstack([np.eye(d)] * 3)
    if kind == "pairs":
        return rng.standard_normal((3 * d, d)) @ np.diag(np.repeat(np.arange(1, d + 1), 2)[:d].astype(float))
    if kind == "near":
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        return q * (1 + 1e-13 * np.arange(d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    if kind == "deficient":
        return rng.standard_normal((3 * d, max(1, d // 2))) @ rng.standard_normal((max(1, d // 2), d))
    return np.diag(np.ones(d)) + np.diag(np.ones(d - 1), 1)  # glued


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "pairs", "near", "deficient", "glued"])
@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_directions(kind, d):
    rows = hard(kind, d, np.random.default_rng(d))
    squares, basis = whitening.directions(whitening.triangle(rows), d)
    want = np.linalg.svd(rows, compute_uv=False) ** 2
    k = len(squares)
    assert (want[k:] <= 1e-20 * want[0]).all() or kind == "deficient" and (want[k:] <= 1e-26 * want[0]).all()
    assert np.allclose(squares, want[:k], rtol=1e-11, atol=1e-15 * want[0])
    assert np.abs(basis.T @ basis - np.eye(k)).max() < 1e-12
    assert np.abs(rows.T @ (rows @ basis) - basis * squares).max() < 1e-12 * want[0] * d


def test_small_values_keep_relative_accuracy():
    d = 30
    a, b = 10.0 ** -np.linspace(0, 12, d), 0.3 * 10.0 ** -np.linspace(0, 12, d)[1:]
    got = whitening.dqds(a, b)
    # one-sided Jacobi-accurate values from the inverse of a well conditioned scaling
    from fractions import Fraction

    q = [Fraction(x) ** 2 for x in a]
    e = [Fraction(x) ** 2 for x in b]

    def below(x):  # how many squares are less than x, exactly
        count, s = 0, -x
        for i in range(d):
            pivot = q[i] + s
            count += pivot < 0
            if i < d - 1:
                s = Fraction(float(e[i] * s / pivot)) - x if pivot else Fraction(0)
        return count

    for i, value in enumerate(got):
        lo, hi = Fraction(value * (1 - 1e-9)), Fraction(value * (1 + 1e-9))
        assert below(lo) <= d - 1 - i < below(hi)


def plain(x, k):
    n, s = len(x), x.sum(axis=0)
    apart = n * x - s
    centred = apart / n
    v = centred.T @ centred / n
    e, z = np.linalg.eigh(v)
    e, z = e[::-1][:k], z[:, ::-1][:, :k]
    return (apart.astype(object) ** 2).sum(axis=1), centred @ z / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("n,d,k", [(500, 8, 8), (3000, 40, 32), (90, 64, 32), (5, 3, 3)])
def test_same_as_eigenvectors(spark, n, d, k):
    rng = np.random.default_rng(n)
    vectors = (rng.standard_normal((n, d)) @ rng.standard_normal((d, d))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = whitening.whiten(frame.repartition(7)).toPandas().sort_values(["vec_id", "component"])
    deviation, whitened, explained = plain(np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000, k)
    assert len(got) == n * k and set(got.n) == {n}
    assert (got.deviation.to_numpy().reshape(n, k) == deviation.astype(np.int64)[:, None]).all()
    mine = got.whitened.to_numpy().reshape(n, k)
    sign = np.sign((mine * whitened).sum(axis=0))
    assert np.allclose(mine * sign, whitened, atol=1e-8)
    assert np.allclose(got.explained.to_numpy().reshape(n, k), explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


SCHEMA = "vec_id long, embedding array<float>, n long, x string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)


def test_bad_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), float(i % 7), float(i * i % 11)]) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]), (104, [1.0, -inf, 1.0])]
    got = whitening.whiten(frame(spark, good + bad)).toPandas()
    assert set(got.vec_id) == set(range(60)) and set(got.n) == {60} and len(got) == 180


def test_repeated_and_null_ids_are_answered_row_by_row(spark):
    rows = [(i % 2 or None, [float(i % 5), float(i % 7)]) for i in range(40)]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert len(got) == 80 and got.vec_id.isna().sum() == 40


def test_components_without_variance_are_left_out(spark):
    rows = [(i, [float(i), float(2 * i), 3.0]) for i in range(50)]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert set(got.component) == {1} and abs(got.explained.iloc[0] - 1) < 1e-12
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0


def test_lengths_and_sizes_that_cannot_be_worked_on_raise(spark):
    with pytest.raises(ValueError, match="different lengths"):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(OverflowError, match="64 bits"):
        whitening.whiten(frame(spark, [(1, [1e17]), (2, [-1e17])] * 3))
    with pytest.raises(Exception, match="a deviation needs more than 64 bits"):
        whitening.whiten(frame(spark, [(1, [1e12]), (2, [-1e12])] * 3)).collect()
