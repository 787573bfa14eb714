import math

import numpy as np
import pytest

from shoebox.llm import whitening


def brute(vectors, most=32):
    """n, deviations, eigenvalues, whitened rows and trace by numpy's own decomposition of the centred scatter."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    moved = n * x - s
    v = (moved.T @ moved / n**3).astype(float)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    keep = min(most, int((e > 1e-10 * e[0]).sum()))
    return n, (moved * moved).sum(1).tolist(), e[:keep], (moved / n).astype(float) @ u[:, :keep] / np.sqrt(e[:keep]), float(np.trace(v))


def check(spark, vectors, df):
    got = {}
    for r in whitening.whiten(df).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    n, deviations, e, z, trace = brute(vectors)
    assert len(got) == n
    for i, deviation in enumerate(deviations):
        own = got[i]
        assert sorted(own) == list(range(1, len(e) + 1))
        assert {(r.n, int(r.deviation)) for r in own.values()} == {(n, deviation)}
        assert all(abs(own[k + 1].explained / (e[k] / trace) - 1) < 1e-7 and own[k + 1].identity_error < 1e-8 for k in range(len(e)))
    signs = [np.sign(got[0][k + 1].whitened * z[0, k]) for k in range(len(e))]
    assert all(abs(got[i][k + 1].whitened - signs[k] * z[i, k]) < 1e-5 for i in range(n) for k in range(len(e)))


@pytest.mark.parametrize("case", ["plain", "wide", "graded", "rank"])
def test_whitening_is_that_of_numpy(spark, case):
    rng = np.random.default_rng(5)
    d = {"plain": 8, "wide": 40, "graded": 5, "rank": 6}[case]
    x = rng.normal(size=(300, d)) * (10.0 ** np.arange(0, d) if case == "graded" else 1 + np.arange(d) / 4)
    if case == "rank":
        x = np.round(x * 64)[:, [0, 1, 2, 2, 1, 0]] / 64  # three columns repeat, so the rank is three
    vectors = [[float(c) for c in v] for v in x]
    extra = [(None, "c"), ([], "c"), ([1.0, None] * (d // 2), "c"), ([float("nan")] * d, "c"), ([float("inf")] * d, "c")]
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(vectors)] + [(900 + i, v, c) for i, (v, c) in enumerate(extra)], "vec_id long, embedding array<double>, n string").repartition(5)
    check(spark, vectors, df)


def test_lengths_are_fitted_apart_and_repeated_rows_count(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [1.5, -1.0]), (2, [1.0, 2.0, 3.0]), (3, [4.0, 1.0, 0.0]), (4, [1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.n), []).append(r)
    assert {k: len(v) for k, v in by.items()} == {(1, 3): 2, (None, 3): 1, (2, 2): 1, (3, 2): 1}  # one direction each; a row alone has none
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in got)
    assert len({(r.vec_id, r.deviation, r.whitened) for r in by[(1, 3)]}) == 1


def test_nothing_to_whiten(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, None)], "vec_id long, embedding array<float>")
    assert whitening.whiten(df).collect() == [] and whitening.whiten(df.limit(0)).collect() == []


def test_deviations_past_64_bits_stay_exact():
    x = np.array([[10**15, 3], [1, 2], [7, 2]], np.int64)
    sums = [int(s) for s in x.sum(0)]
    center = np.array([s // 3 for s in sums], np.int64)
    own = whitening.Whitener(3, center, [s - 3 * int(c) for s, c in zip(sums, center)], np.eye(2), np.ones(2), 2.0)
    assert own.deviations(x) == [sum((3 * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]


def test_jacobi_on_a_factor_keeps_small_values():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    values = 10.0 ** -np.arange(12)
    w = whitening.one_sided_jacobi(whitening.pivoted_cholesky((q * values) @ q.T))
    assert np.allclose(np.sort((w * w).sum(0))[::-1], values, rtol=1e-4, atol=0)
    assert np.abs(w.T @ w - np.diag((w * w).sum(0))).max() < 1e-14
