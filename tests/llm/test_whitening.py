"""Exact polynomials and whitened vectors against plain linear algebra."""

import math
from fractions import Fraction

import numpy as np
import pytest
from conftest import MEDIUM

from holdfast.llm import charpoly
from holdfast.llm.queries import op12_whitening
from holdfast.llm.whitening import Whitening, _products, fitted, scatter, sums, usable, whitened


def polynomial(matrix):
    """Faddeev-LeVerrier in fractions, x**0 first."""
    d = len(matrix)
    m = [[Fraction(0)] * d for _ in range(d)]
    c = [Fraction(0)] * d + [Fraction(1)]
    for k in range(1, d + 1):
        m = [
            [sum(matrix[i][a] * m[a][j] for a in range(d)) + (c[d - k + 1] if i == j else 0)
             for j in range(d)]
            for i in range(d)
        ]
        trace = sum(sum(matrix[i][a] * m[a][i] for a in range(d)) for i in range(d))
        c[d - k] = -trace / k
    return [int(v) for v in c]


def gram(rows):
    return (rows.T @ rows).tolist()


DRAW = np.random.default_rng(5)
MATRICES = {
    "one": [[7]],
    "two": [[2, 1], [1, 2]],
    "diagonal": [[5, 0, 0], [0, 5, 0], [0, 0, 0]],
    "zeros below the pivot": [[3, 0, 1, 0], [0, 2, 0, 0], [1, 0, 3, 1], [0, 0, 1, 9]],
    "rank two": gram(DRAW.integers(-9, 9, (2, 6))),
    "full": gram(DRAW.integers(-300, 300, (40, 9))),
    "wide range": gram(DRAW.integers(-300, 300, (40, 7)) * 10 ** np.arange(7)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_polynomial_roots_and_vectors(name):
    matrix = [[int(v) for v in row] for row in MATRICES[name]]
    primes = charpoly.primes_for(matrix)
    found = charpoly.remaindered(charpoly.residues(matrix, primes), primes)
    assert found == polynomial(matrix)
    parts = charpoly.principal(matrix, found, 20)
    want = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
    # The lowest power with a coefficient is the number of eigenvalues that are 0.
    assert len(parts) == len(matrix) - next(k for k, c in enumerate(found) if c)
    for (value, vector), w in zip(parts, want):
        assert float(value) == pytest.approx(w, rel=1e-6, abs=1e-12 * want[0])
        exact = [sum(Fraction(a) * Fraction(v) for a, v in zip(row, vector)) for row in matrix]
        rest = max(abs(e - Fraction(value) * Fraction(v)) for e, v in zip(exact, vector))
        assert rest <= Fraction(1e-14) * Fraction(float(want[0]))
    axes = np.array([v for _, v in parts])
    assert np.abs(axes @ axes.T - np.eye(len(axes))).max() < 1e-13


def test_products_are_exact():
    for top in (3, 1 << 19, 1 << 21, 1 << 45, 1 << 61):
        y = DRAW.integers(-top, top, (50, 4))
        want = [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in y.T] for p in y.T]
        assert _products(y).tolist() == want


def test_query_against_plain_linear_algebra(spark):
    rows = spark.read.parquet(f"{MEDIUM}/embeddings.parquet").collect()
    ids = [r.vec_id for r in rows]
    x = np.floor(1024 * np.array([r.embedding for r in rows], float)).astype(int) + 100_000
    n, total = len(x), x.sum(axis=0)
    y = x - total / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = y @ vectors[:, :8] / np.sqrt(values[:8])
    got = op12_whitening(spark, MEDIUM).collect()
    assert len(got) == n * 8
    place = {v: i for i, v in enumerate(ids)}
    mine = np.zeros((n, 8))
    for r in got:
        mine[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.deviation == int(((n * x[place[r.vec_id]] - total) ** 2).sum())
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * sign - want).max() < 1e-8


def test_scatter_is_exact_for_every_partitioning(spark):
    how = Whitening()
    draws = [(i, DRAW.normal(0, 10.0 ** (i % 9), 5).tolist()) for i in range(60)]
    want = None
    for parts in (1, 4, 9):
        df = spark.createDataFrame(draws, "vec_id int, embedding array<double>").repartition(parts)
        rows = usable(df, "vec_id", "embedding")
        n, total = sums(rows, how)
        x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in draws]
        assert (n, total) == (60, [sum(col) for col in zip(*x)])
        matrix = scatter(rows, n, total, how)
        want = want or [
            [n * sum(r[i] * r[j] for r in x) - total[i] * total[j] for j in range(5)]
            for i in range(5)
        ]
        assert matrix == want


def test_edge_cases(spark):
    fields = "vec_id bigint, embedding array<float>, id int, n string, whitened double"
    good = [(i, [float(i % 3), float(i % 2), 1.0], i, "x", 0.0) for i in range(6)]
    bad = [
        (10, None, 1, "", 1.0),
        (11, [1.0, None, 1.0], 1, "", 1.0),
        (12, [1.0, float("nan"), 1.0], 1, "", 1.0),
        (13, [1.0, float("inf"), 1.0], 1, "", 1.0),
        (14, [1.0], 1, "", 1.0),
        (15, [], 1, "", 1.0),
        (16, [1e30, 0.0, 0.0], 1, "", 1.0),
    ]
    rows = good + bad + [good[0], (None, [0.0, 0.0, 1.0], None, None, None)]
    df = spark.createDataFrame(rows, fields)
    got = whitened(df).collect()
    assert sorted((r.vec_id is not None, r.vec_id) for r in got) == sorted(
        [(True, i) for i in (0, 0, 1, 2, 3, 4, 5)] + [(False, None)]
    )
    # A dimension without variance carries no component.
    assert {len(r.whitened) for r in got} == {2} and {r.n for r in got} == {8}
    assert len({tuple(r.whitened) for r in got if r.vec_id in (0, None)}) == 1
    assert whitened(df.limit(0)).count() == 0
    assert whitened(df.where("vec_id = 10")).count() == 0
    assert whitened(df.where("vec_id = 3")).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id int, embedding array<double>")
    assert whitened(same).count() == 0


def test_deviation_beyond_a_long(spark):
    far = [(0, [2.0**40, 0.0]), (1, [-(2.0**40), 1.0]), (2, [0.0, 5.0])]
    df = spark.createDataFrame(far, "vec_id int, embedding array<double>")
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in far]
    total = [sum(c) for c in zip(*x)]
    want = {i: sum((3 * a - s) ** 2 for a, s in zip(x[i], total)) for i in range(3)}
    assert {r.vec_id: int(r.deviation) for r in whitened(df).collect()} == want


def test_equal_eigenvalues_have_an_orthonormal_basis(spark):
    corners = [(i, [float(s) if j == i // 2 else 0.0 for j in range(4)])
               for i, s in enumerate([1, -1] * 4)]
    df = spark.createDataFrame(corners, "vec_id int, embedding array<double>")
    basis = fitted(usable(df, "vec_id", "embedding"), Whitening())
    assert np.abs(basis.axes @ basis.axes.T * np.linalg.norm(basis.axes[:, 0]) ** -2 - np.eye(4)).max() < 1e-12
    assert whitened(df).first().identity_error < 1e-12
