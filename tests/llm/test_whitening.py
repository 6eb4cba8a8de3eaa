"""Whitening against numpy's eigenvalues and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from feedlake.llm import whitening
from feedlake.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n long, code string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 9, 9, "x") for i, v in rows], SCHEMA)


def brute(rows):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in good]
    fit = np.array(sorted({tuple(v) for _, v in x}), np.int64)
    n, sums = len(fit), [sum(map(int, c)) for c in fit.T]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    v = (fit - mean).T @ (fit - mean) / n
    e, w = np.linalg.eigh(v)
    return x, n, sums, mean, v, e[::-1], w[:, ::-1]


def check(spark, rows):
    got = whitening.whiten(table(spark, rows)).collect()
    x, n, sums, mean, v, e, w = brute(rows)
    k = min(16, int((e > 1e-12 * v.trace()).sum()))
    assert len(got) == k * len(x)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert sorted({c for _, c in by}) == list(range(1, k + 1))
    deviation = {}
    for i, row in x:
        deviation.setdefault(i, set()).add(sum((n * c - s) ** 2 for c, s in zip(row, sums)))
    for (i, c), rs in by.items():
        for r in rs:
            assert r["n"] == n and r["deviation"] in deviation[i] and r["identity_error"] <= 1e-4
            assert r["explained"] == pytest.approx(e[c - 1] / v.trace(), rel=1e-9)
    simple = [c for c in range(k) if min(abs(e[c] - e[j]) for j in range(len(e)) if j != c) > 1e-6 * e[0]]
    for c in simple:
        sign = None
        for i, row in x:
            want = (np.array(row) - mean) @ w[:, c] / np.sqrt(e[c])
            near = min((r["whitened"] for r in by[(i, c + 1)]), key=lambda y: abs(abs(y) - abs(want)))
            assert abs(near) == pytest.approx(abs(want), abs=1e-6)
            if abs(want) > 1e-3 and len(by[(i, c + 1)]) == 1:
                assert sign in (None, near * want > 0)
                sign = near * want > 0
    return got


def test_equals_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 24)) * np.linspace(3, 0.2, 24)
    check(spark, [(int(i), [float(c) for c in row]) for i, row in enumerate(x)])


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = [(int(i), [float(c) for c in row]) for i, row in enumerate(rng.standard_normal((30, 4)))]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, float("nan"), 2.0, 3.0]), (103, [float("inf"), 0.0, 0.0, 0.0]),
           (104, base[0][1]), (3, base[3][1]), (3, base[5][1]), (None, [0.5, 0.25, -3.0, 1000.0])]
    check(spark, base + odd + [(105, base[7][1])] * 40)
    other = whitening.whiten(table(spark, base + [(200, [1.0, 2.0]), (201, [])]))
    assert other.where("vec_id >= 200").count() == 0 and other.count() == 120


def test_equal_eigenvalues_and_missing_components(spark):
    cube = [(i, [8.0 * ((i >> k) & 1) for k in range(3)]) for i in range(8)]  # three equal eigenvalues
    check(spark, cube)
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]  # one component with variance
    assert {r["component"] for r in check(spark, line)} == {1}
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        got = whitening.whiten(table(spark, rows))
        assert got.collect() == [] and got.columns[:2] == ["vec_id", "component"]


def test_large_entries(spark):
    rng = np.random.default_rng(5)
    big = [(int(i), [float(np.float32(c)) for c in row * 1e12]) for i, row in enumerate(rng.standard_normal((20, 3)))]
    got = whitening.whiten(table(spark, big + [(99, [3e38, 0.0, 0.0])]))
    assert got.count() == 63


def test_solver_on_hard_spectra():
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    for spectrum in (np.r_[[5.0] * 20, [1.0] * 20], np.ones(40), np.exp(-np.arange(40.0)), np.r_[[1.0] * 15, 0.999999, 0.9999989, [0.1] * 23],
                     np.r_[[2.0], [0.0] * 39], np.linspace(1, 1.001, 40)):
        v = q @ np.diag(spectrum) @ q.T
        v = (v + v.T) / 2
        e, w = whitening.components(v)
        want = np.sort(spectrum)[::-1]
        want = want[want > 1e-12 * want.sum()][:16]
        assert len(e) == len(want) and np.abs(e - want).max() < 1e-12 * want[0]
        assert np.abs(w.T @ w - np.eye(len(e))).max() < 1e-13 and np.abs(v @ w - w * e).max() < 1e-12 * want[0]
        assert whitening.above(v, float(spectrum.max()) * 1.01) == 0 and whitening.above(v, -1.0) == 40


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = op11_whitening(spark, folder)
    assert got.count() == 16 * spark.read.parquet(f"{folder}/embeddings.parquet").count()
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                          ("explained", "double"), ("identity_error", "double")]
