import math
import random

import numpy as np
import pytest

from trajlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string"


def expected(vectors, components=8):
    """By numpy, in doubles but for sums: x, n, deviations, eigenvalues and unit vectors of the covariance, its trace."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    _, values, vectors = np.linalg.svd(centred)  # not of the covariance, whose small eigenvalues are less exact
    values = values**2 / n
    return centred, deviation, values[:components], vectors[:components], values.sum()


def check(spark, vectors, kinds=None, exact=1e-9):
    df = spark.createDataFrame([(i, [float(c) for c in v], 0, 5, "x") for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    centred, deviation, values, directions, trace = expected(vectors)
    rows = whitening.whitening(df).collect()
    k = len({r.component for r in rows})
    assert len(rows) == k * len(vectors) and {r.component for r in rows} == set(range(1, k + 1))
    assert k == min(8, int(np.sum(values > 1e-9 * values[0])))
    assert {r.n for r in rows} == {len(vectors)} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-8
    got = np.zeros((len(vectors), k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id]
        assert abs(r.explained - values[r.component - 1] / trace) <= 1e-10 * r.explained
    want = centred @ directions[:k].T / np.sqrt(values[:k])
    for j in range(k) if kinds is None else kinds:
        sign = np.sign(got[:, j] @ want[:, j])
        assert np.max(np.abs(sign * got[:, j] - want[:, j])) < exact, j
    return got


def test_whitening(spark):
    r = np.random.default_rng(1)
    check(spark, r.standard_normal((300, 20)) @ np.diag(np.linspace(3, 0.2, 20)))


def test_few_large_directions_end_early(spark, monkeypatch):
    r = np.random.default_rng(2)
    vectors = r.standard_normal((400, 60)) * np.concatenate([2.0 ** -np.arange(9), np.full(51, 1e-5)])
    steps = []
    kept = whitening._summed
    monkeypatch.setattr(whitening, "_summed", lambda *a: steps.append(1) or kept(*a))
    check(spark, vectors)
    assert len(steps) < 50


def test_equal_eigenvalues_are_all_found(spark):
    cube = [[1.0 if i == j else -1.0 if i == j + 12 else 0.0 for j in range(12)] for i in range(24)]  # the covariance is a multiple of the identity
    got = check(spark, cube, kinds=[])
    assert got.shape == (24, 8)


@pytest.mark.parametrize(("n", "d"), [(2, 5), (3, 3), (9, 12), (40, 1), (30, 2)])
def test_few_vectors_or_dimensions(spark, n, d):
    check(spark, np.random.default_rng(n).standard_normal((n, d)))


def test_flat_dimensions(spark):
    r = np.random.default_rng(4)
    vectors = np.hstack([r.standard_normal((50, 4)), np.full((50, 3), 0.25)])
    vectors[:, 3] = vectors[:, 0] * 2
    check(spark, vectors)


def test_rows_that_go(spark):
    r = random.Random(5)
    fine = [(i, [r.gauss(0, 1) for _ in range(4)], 0, 1, "") for i in range(20)]
    odd = [(50, None, 0, 1, ""), (51, [1.0, None, 0.0, 0.0], 0, 1, ""), (52, [1.0, float("nan"), 0.0, 0.0], 0, 1, ""), (53, [1.0, float("inf"), 0.0, 0.0], 0, 1, ""), (54, [], 0, 1, ""), (55, [1.0, 2.0], 0, 1, ""), (56, [1e30, 0.0, 0.0, 0.0], 0, 1, "")]
    again = [(None, fine[0][1], 0, 1, ""), (3, fine[3][1], 0, 1, "")]
    rows = whitening.whitening(spark.createDataFrame(fine + odd + again, SCHEMA)).collect()
    assert sorted({r.vec_id for r in rows}, key=str) == sorted([*range(20), None], key=str)
    assert len(rows) == 22 * 4 and rows[0].n == 22
    assert whitening.whitening(spark.createDataFrame(odd[:5], SCHEMA)).count() == 0
    assert whitening.whitening(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitening(spark.createDataFrame([(i, [1.0, 2.0], 0, 1, "") for i in range(5)], SCHEMA)).count() == 0


def test_deviation_beyond_a_long_is_null(spark):
    far = spark.createDataFrame([(i, [float(i % 2) * 2e9], 0, 1, "") for i in range(6)], SCHEMA)
    rows = whitening.whitening(far).collect()
    assert len(rows) == 6 and all(r.deviation is None and abs(abs(r.whitened) - 1) < 1e-12 for r in rows)
