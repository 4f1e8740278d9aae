"""LOBPCG whitening against a dense eigendecomposition in plain numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from kmerloom.llm.whitening import LARGEST, lobpcg, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=16):
    usable = [(i, [math.floor(64 * c) + 1_000_000 for c in map(float, v)]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(x) for x in sorted({tuple(x) for _, x in usable})]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    cov = z.T @ z / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    out = {}
    for i, x in usable:
        c = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        out.setdefault(i, []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), c @ axes / np.sqrt(e)))
    return out, e / np.trace(cov)


def compare(spark, rows, k=16):
    got = whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    want, explained = brute(rows, k)
    assert len(got) == k * sum(map(len, want.values()))
    table = {}
    for r in got:
        table.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
        assert abs(r.explained - explained[r.component - 1]) <= 1e-9
        assert 0 <= r.identity_error < 1e-8
    signs = {}
    for i, found in want.items():
        assert sorted(table[i]) == list(range(1, k + 1))
        for c, mine in table[i].items():
            assert sorted((r.n, r.deviation) for r in mine) == sorted((n, d) for n, d, _ in found)
            if len(found) == 1:
                w = found[0][2][c - 1]
                if c not in signs and abs(w) > 0.1:
                    signs[c] = np.sign(w) * np.sign(mine[0].whitened)
                assert abs(abs(mine[0].whitened) - abs(w)) < 1e-7
                assert abs(w) < 0.1 or np.sign(mine[0].whitened) * signs[c] == np.sign(w)


def test_whitening_agrees_with_dense_eigenvectors(spark):
    g = np.random.default_rng(3)
    x = (g.standard_normal((400, 40)) * np.linspace(2, 0.3, 40)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # copies count once in the fit
    rows += [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 38), (2003, [math.nan] * 40), (2004, [math.inf] + [0.0] * 39)]
    compare(spark, rows)


def test_fewer_dimensions_than_components(spark):
    g = np.random.default_rng(4)
    compare(spark, [(i, v.tolist()) for i, v in enumerate((g.standard_normal((60, 3)) * [3, 2, 1]).astype(np.float32))], k=3)


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whiten(empty).count() == 0 and len(whiten(empty).columns) == 7
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 5 + [(2, None, 1)], SCHEMA)).count() == 0  # no spread
    flat = whiten(spark.createDataFrame([(i, [float(i), 1.0, float(2 * i)], 0) for i in range(9)], SCHEMA)).collect()  # rank 1
    assert {r.component for r in flat} == {1} and len(flat) == 9
    ragged = whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 1.0], 0), (3, [1.0], 0), (None, [5.0, 5.0], 0)], SCHEMA)).collect()
    assert {r.vec_id for r in ragged} == {1, 2, None}


def test_large_entries_and_deviations_beyond_a_long(spark):
    far = whiten(spark.createDataFrame([(1, [1e30, 0.0], 0), (2, [0.0, 1.0], 0), (3, [-1e30, 5.0], 0)], SCHEMA)).collect()
    assert {r.deviation for r in far if r.vec_id == 1} == {None}
    assert LARGEST == 1 << 52
    near = whiten(spark.createDataFrame([(i, [4e4 * i, float(i % 3)], 0) for i in range(5)], SCHEMA)).collect()
    x = [[64 * 40000 * i + 1_000_000, 64 * (i % 3) + 1_000_000] for i in range(5)]
    sums = [sum(c) for c in zip(*x)]
    assert {r.vec_id: r.deviation for r in near} == {i: sum((5 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}


def test_other_columns_and_vector_names(spark):
    rows = spark.createDataFrame([(i, [float(i), float(i * i % 7)], "x", 1) for i in range(20)], "vec_id int, `a.b` array<double>, vector string, y int")
    assert whiten(rows, "a.b").count() == 40


@pytest.mark.parametrize("dim,spread", [(120, 0.0), (300, 0.5), (90, 3.0)])
def test_lobpcg_of_many_dimensions(dim, spread):
    g = np.random.default_rng(dim)
    q = np.linalg.qr(g.standard_normal((dim, dim)))[0]
    e = np.sort(np.exp(spread * g.standard_normal(dim)) + g.random(dim))[::-1]
    v = q * e @ q.T
    found, axes = lobpcg(lambda b: v @ b, dim, 16)
    assert np.allclose(found, e[:16], rtol=1e-11)
    assert np.abs(v @ axes - axes * found).max() <= 1e-11 * e[0]
    assert np.abs(axes.T @ axes - np.eye(16)).max() < 1e-12
