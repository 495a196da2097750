"""Whitening: eigenpairs against a dense solver, exact deviations, odd tables, and the registered query."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import queries as Q
from termloom.llm.whitening import differences, leading_eigenpairs, minres, side_by_side, squares, whiten, whole_vectors

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def symmetric(values: np.ndarray, seed: int = 1) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 100, 200), 1 / np.arange(1.0, 301), np.array([5.0, 5, 5, 5, 5, 5, 1, 1, 1, 1, 0.5, 0.1]), np.r_[1e6, np.full(80, 1.0)], np.r_[np.linspace(1, 1.01, 60)], np.zeros(9), np.array([3.0]), np.r_[np.ones(3), np.zeros(20)],
    ],
)
def test_eigenpairs_reach_double_precision(values: np.ndarray) -> None:
    """Spread, close, repeated and vanishing eigenvalues; every residual at rounding level, nothing missed."""
    a, asked = symmetric(values), []

    def multiply(w: np.ndarray) -> np.ndarray:
        asked.append(w.shape[1])
        return a @ w

    found, q = leading_eigenpairs(multiply, len(values), 8)
    k = min(8, len(values))
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:k]
    top = max(abs(want[0]), 1e-300)
    assert np.abs(found - want).max() <= 1e-12 * top and np.abs(q.T @ q - np.eye(k)).max() < 1e-12
    assert np.linalg.norm(a @ q - q * found, axis=0).max() <= 1e-13 * top * math.sqrt(len(values))
    assert len(asked) < 300


def test_minres_solves() -> None:
    a = symmetric(np.r_[np.linspace(-3, -1, 15), np.linspace(2, 5, 15)])
    rhs = [np.arange(30.0), np.ones(30), np.zeros(30)]
    solved = side_by_side([minres(b, 0.5, lambda x: x, 60, 1e-13) for b in rhs], lambda w: a @ w)
    assert all(np.abs((a - 0.5 * np.eye(30)) @ t - b).max() < 1e-9 for t, b in zip(solved, rhs))


def test_whole_numbers_of_any_size() -> None:
    x = np.array([[2**52, -(2**52)], [7, 100_003], [100_000, 100_000]])
    for n in (3, 10**7):
        sums = [int(s) for s in x.sum(axis=0)]
        exact = [[n * int(a) - s for a, s in zip(row, sums)] for row in x]
        d = differences(x, n, sums)
        assert [list(map(int, row)) for row in d] == exact and squares(d) == [sum(v * v for v in row) for row in exact]


def check(rows: list, embeddings: dict) -> None:
    """Rows of the operator against numpy over the same vectors (several ids may share one)."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in embeddings.values()], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    d = n * x - sums
    centred = d.astype(float) / n
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1], q[:, ::-1]
    place = {i: j for j, i in enumerate(embeddings)}
    components = sorted({r.component for r in rows})
    assert len(rows) == n * len(components)
    trace = sum(sum(int(c) ** 2 for c in row) for row in d) / n**3
    whitened = np.zeros((n, len(components)))
    for r in rows:
        assert r.n == n and int(r.deviation) == sum(int(c) ** 2 for c in d[place[r.vec_id]])
        assert abs(r.explained - values[r.component - 1] / trace) <= 1e-10 * r.explained
        whitened[place[r.vec_id], r.component - 1] = r.whitened
    for j in range(len(components)):
        want = centred @ q[:, j] / math.sqrt(values[j])
        assert min(np.abs(whitened[:, j] - want).max(), np.abs(whitened[:, j] + want).max()) < 1e-7
    assert np.abs(np.cov(whitened.T, bias=True) - np.eye(len(components))).max() < 1e-9
    assert len({r.identity_error for r in rows}) == 1 and 0 <= rows[0].identity_error < 1e-9


def test_op13(spark) -> None:  # noqa: ANN001
    data = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    rows = Q.op13_whitening(spark, DATA).collect()
    check(rows, data)
    assert {r.component for r in rows} == set(range(1, 9)) and all(isinstance(r.deviation, int) and int(r.deviation_exact) == r.deviation for r in rows)


def test_whitening_of_odd_tables(spark) -> None:  # noqa: ANN001
    """Nulls, non-finite and ragged vectors take no part; repeated rows, few dimensions, clashing columns, equal vectors, no vectors."""
    nan, inf = float("nan"), float("inf")
    good = {1: [0.5, -0.25, 1.0], 2: [0.1, 0.2, 0.3], 3: [-1.0, 0.75, 0.125], 4: [2.0, 2.0, -2.0], 5: [0.5, -0.25, 1.0]}
    bad = [(10, None), (11, [nan, 0.0, 0.0]), (12, [inf, 0.0, 0.0]), (13, [None, 0.0, 0.0]), (14, []), (15, [1.0]), (16, [1.0, 2.0, 3.0, 4.0])]
    table = spark.createDataFrame([*good.items(), *bad], SCHEMA).withColumns({c: F.lit(c) for c in ("x", "width", "data", "component")})
    check(whiten(whole_vectors(table)).collect(), good)
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (None, [1.0, 5.0])], SCHEMA)
    assert sorted((r.vec_id or 0, r.component) for r in whiten(whole_vectors(flat)).collect()) == [(0, 1), (1, 1), (2, 1)]
    for none in (flat.limit(0), flat.filter("vec_id = 1"), spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA), spark.createDataFrame(bad[:3], SCHEMA)):
        assert whiten(whole_vectors(none)).count() == 0
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 0.5]), (3, [0.0, 0.25])], SCHEMA)
    rows = whiten(whole_vectors(huge)).collect()
    assert {r.vec_id for r in rows} == {1, 2, 3} and all(math.isfinite(r.whitened) for r in rows)
