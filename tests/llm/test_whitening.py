"""Whitening against exact fractions and an independent decomposition."""

from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from lodestitch.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, component string"


def exact(vectors):
    """(n, sums, covariance as fractions, squared deviations) of integer vectors, by the definition."""
    n, d = len(vectors), len(vectors[0])
    sums = [sum(v[j] for v in vectors) for j in range(d)]
    centred = [[Fraction(n * v[j] - sums[j], n) for j in range(d)] for v in vectors]
    cov = [[sum(c[i] * c[j] for c in centred) / n for j in range(d)] for i in range(d)]
    return n, sums, cov, [sum((n * v[j] - sums[j]) ** 2 for j in range(d)) for v in vectors]


def held(spark, vectors, components=8, parts=3):
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(vectors)], SCHEMA).repartition(parts)
    return W.whiten(df, components).collect()


@pytest.mark.parametrize("spread", [1.0, 1e5, 1e9])
def test_equals_exact_fractions(spark, spread):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(60, 5)) * [1, 2, 3, 4, 5] * spread / 5).tolist()
    n, sums, cov, deviations = exact([[floor(1024 * c) + 100000 for c in v] for v in vectors])
    values, axes = np.linalg.eigh(np.array([[float(x) for x in r] for r in cov]))
    values, axes = values[::-1], axes[:, ::-1]
    rows = held(spark, vectors, 3)
    assert len(rows) == 180
    z = np.zeros((60, 3))
    for r in rows:
        assert r.n == 60
        assert r.deviation == (deviations[r.vec_id] if deviations[r.vec_id] < 2**63 else None)
        assert r.explained == pytest.approx(float(values[r.component - 1] / values.sum()), rel=1e-9)
        z[r.vec_id, r.component - 1] = r.whitened
    centred = np.array([[float(Fraction(60 * (floor(1024 * c) + 100000) - s, 60)) for c, s in zip(v, sums)] for v in vectors])
    for k in range(3):
        expected = centred @ axes[:, k] / np.sqrt(values[k])
        sign = np.sign(expected @ z[:, k])
        assert np.allclose(z[:, k], sign * expected, rtol=1e-9, atol=1e-9)
    assert np.allclose(z.T @ z / 60, np.eye(3), atol=1e-9)
    assert 0 <= rows[0].identity_error < 1e-9 and len({r.identity_error for r in rows}) == 1


def test_digit_products_are_exact_beyond_float64():
    rng = np.random.default_rng(1)
    for top in (3, 2**17, 2**18 + 1, 2**40, 2**61):
        y = rng.integers(-top, top, size=(50, 4), dtype=np.int64)
        y[0] = [top, -top, top, -top]
        parts = W.digit_products(y)
        found = sum(m.astype(object) * (1 << (W.LIMB * w)) for w, m in parts.items())
        big = y.astype(object)
        assert (found == big.T.dot(big)).all()


def test_a_full_block_of_the_largest_digits_is_exact():
    y = np.full((W.BLOCK, 2), -(1 << (W.LIMB - 1)), np.int64)
    assert (W.digit_products(y)[0] == W.BLOCK * (1 << (2 * W.LIMB - 2))).all()


def test_covariance_keeps_small_spread_far_from_zero(spark):
    # Float64 sums of squares would lose all of this variance.
    vectors = [[1e12 + (i % 2) / 1024, 1.0] for i in range(20)]
    rows = held(spark, vectors, 1)
    assert {abs(round(r.whitened, 9)) for r in rows} == {1.0}
    assert rows[0].explained == pytest.approx(1.0)


def test_unusable_rows_are_dropped_and_repeats_stay(spark):
    rows = [
        (1, [1.0, 2.0], ""), (1, [1.0, 2.0], ""), (None, [3.0, 1.0], None), (4, None, ""), (5, [None, 1.0], ""), (6, [nan, 1.0], ""),
        (7, [inf, 0.0], ""), (8, [-inf, 0.0], ""), (9, [], ""), (10, [1.0, 2.0, 3.0], ""), (11, [0.5, 7.0], ""),
    ]
    found = W.whiten(spark.createDataFrame(rows, SCHEMA), 8).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == sorted([(1, 1), (1, 1), (0, 1), (11, 1), (1, 2), (1, 2), (0, 2), (11, 2)])
    assert {r.n for r in found} == {4}
    assert W.whiten(spark.createDataFrame(rows[3:9], SCHEMA)).collect() == []
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_variance(spark):
    rows = held(spark, [[1.0, 2.0]] * 3)
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in rows} == {(None, None, 0.0, 0)}
    line = held(spark, [[float(i), float(2 * i)] for i in range(9)])
    assert {r.whitened is None for r in line if r.component == 2} == {True}
    assert all(r.identity_error < 1e-9 for r in line)


def test_far_entries_do_not_crash(spark):
    rows = held(spark, [[1e300, 1.0], [-1e300, 2.0], [0.0, 3.0]], 1)
    assert len(rows) == 3 and all(r.whitened is not None for r in rows)
