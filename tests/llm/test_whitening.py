"""Whitening against whole-number arithmetic and a dense covariance."""

import math
import random

import numpy as np
import pytest

from lautwerk.llm.whitening import SCHEMA, _Centre, eigen, whiten

ROWS = "vec_id long, embedding array<double>, n string, component string, m string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in vectors], ROWS)


def expected(vectors):
    """{(id, component): (n, deviation, |whitened|, explained)} by exact sums and numpy."""
    fit = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(fit), len(fit[0][1])
    sums = [sum(x[k] for _, x in fit) for k in range(d)]
    centred = np.array([[(n * x[k] - sums[k]) / n for k in range(d)] for _, x in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for row, (i, x) in enumerate(fit):
        deviation = sum((n * x[k] - sums[k]) ** 2 for k in range(d))
        for c in range(min(32, d)):
            out.append((i, c + 1, n, deviation, abs(centred[row] @ u[:, c] / math.sqrt(e[c])), e[c] / np.trace(v)))
    return out


def compare(got, want):
    order = lambda r: (r[0] is None, r[0], r[1], r[4])
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=order)
    want = sorted(want, key=order)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("d", [3, 40])
def test_whitening_of_odd_rows(spark, d):
    draw = random.Random(d)
    vectors = [(i, [draw.gauss(k / 7, 1 + k / 3) for k in range(d)]) for i in range(150)]
    vectors += [(7, vectors[0][1]), (7, vectors[0][1]), (None, vectors[1][1])]
    odd = [(900, None), (901, []), (902, [1.0] * (d - 1) + [None]), (903, [float("nan")] * d), (904, [float("inf")] + [0.0] * (d - 1)), (905, [-float("inf")] * d), (906, [1.0] * (d + 1))]
    got = whiten(table(spark, vectors + odd).repartition(5)).collect()
    compare(got, expected(vectors))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    for c in range(1, min(d, 32) + 1):
        w = [r["whitened"] for r in got if r["component"] == c]
        assert abs(np.mean(w)) < 1e-9 and abs(np.var(w) - 1) < 1e-9


def test_whitening_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    compare(whiten(df).collect(), expected([(r["vec_id"], r["embedding"]) for r in df.collect()]))


def test_whitening_without_anything_to_whiten(spark):
    for vectors in ([], [(1, None), (2, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9):
        out = whiten(table(spark, vectors))
        assert out.count() == 0 and out.schema == spark.createDataFrame([], SCHEMA).schema
    flat = whiten(table(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0])])).collect()  # one of two directions
    assert {(r["component"], abs(r["whitened"])) for r in flat} == {(1, 1.0)}


def test_vectors_of_most_common_length(spark):
    rows = [(1, [1.0]), (2, [2.0]), (3, [1.0, 0.5]), (4, [2.0, 3.0]), (5, [0.0, 1.0, 2.0])]
    assert {r["vec_id"] for r in whiten(table(spark, rows)).collect()} == {3, 4}


def test_deviations_stay_exact():
    draw = random.Random(1)
    for n, spread in ((5, 100), (10**7, 10**4), (10**9, 10**6), (3, 10**12), (10**10, 2)):
        xs = [[draw.randrange(-spread, spread) + 1_000_000 for _ in range(6)] for _ in range(20)]
        sums = [draw.randrange(-spread, spread) * n + draw.randrange(n) for _ in range(6)]
        want = [sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in xs]
        got = _Centre(n, sums).deviations(np.array(xs, np.int64)).to_pylist()
        assert got == [w if w < 2**63 else None for w in want]


def test_eigenvectors():
    a = np.random.default_rng(2).normal(size=(30, 5))
    e, u = eigen(a.T @ a)
    np.testing.assert_allclose(u.T @ u, np.eye(5), atol=1e-12)
    np.testing.assert_allclose(a.T @ a @ u, u * e, atol=1e-9)
    assert (np.diff(e) < 0).all() and len(eigen(np.zeros((3, 3)))[0]) == 0


def test_huge_entries_count_as_the_largest(spark):
    got = whiten(table(spark, [(1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])])).collect()
    assert all(math.isfinite(r["whitened"]) for r in got) and [r["deviation"] for r in got if r["component"] == 1] == [None, None, 4096]
