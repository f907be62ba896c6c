"""Whitening against plain fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from diffscope.llm import whitening

NAN, INF = float("nan"), float("inf")


def vectors(width=6, n=70, seed=4, scale=1.0):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(3)]
    rows = []
    for i in range(n):
        w = [rng.gauss(0, 1) for _ in range(3)]
        rows.append((i, [scale * (sum(a * b[d] for a, b in zip(w, base)) + 0.1 * rng.gauss(0, 1)) for d in range(width)]))
    odd = [(500, None), (501, [0.1] * (width - 1) + [None]), (502, [NAN] + [0.0] * (width - 1)), (503, [INF] * width),
           (504, []), (505, [0.5] * (width + 1)), (506, [1e30] * width), (None, [0.2] * width)]
    return rows + odd + [rows[0], rows[0]]


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, n long, component int").repartition(5)


def usable(rows, width):
    return [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows
            if v is not None and len(v) == width and all(c is not None and math.isfinite(c) and abs(c) < 2**42 for c in v)]


@pytest.mark.parametrize("scale", [0.2, 1e6])
def test_against_fractions(spark, scale):
    rows, width = vectors(scale=scale), 6
    x = usable(rows, width)
    n = len(x)
    s = [sum(v[d] for _, v in x) for d in range(width)]
    model = whitening.fit(table(spark, rows))
    assert (model.n, model.totals) == (n, s)
    cov = [[Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for _, v in x), n ** 3) for j in range(width)] for i in range(width)]
    exact = np.array([[float(c) for c in r] for r in cov])
    again = model.directions.T @ np.diag(model.eigenvalues) @ model.directions
    assert np.allclose(again, exact, rtol=1e-12, atol=1e-12 * np.abs(exact).max())
    assert np.allclose(model.directions @ model.directions.T, np.eye(width), atol=1e-12)
    assert (np.diff(model.eigenvalues) <= 0).all()
    found = whitening.whitened(table(spark, rows), model).collect()
    expected = {}
    for i, v in x:
        centred = [float(Fraction(a) - Fraction(t, n)) for a, t in zip(v, s)]
        expected.setdefault(i, []).append((sum((n * a - t) ** 2 for a, t in zip(v, s)),
                                           model.directions @ centred / np.sqrt(model.eigenvalues)))
    assert len(found) == n
    for r in found:
        deviation, white = expected[r.vec_id][0]
        assert int(r.deviation) == deviation
        assert np.allclose(r.whitened, white, rtol=1e-9, atol=1e-9)
    assert whitening.identity_error(table(spark, rows), model) < 1e-9


def test_rows(spark):
    rows = vectors(width=10, scale=0.2)
    found = whitening.table(table(spark, rows, "float")).collect()
    n = len(usable(rows, 10))
    assert len(found) == 8 * n and {r.n for r in found} == {n} and {r.component for r in found} == set(range(1, 9))
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-6
    shares = {r.component: r.explained for r in found}
    assert all(shares[c] >= shares[c + 1] for c in range(1, 8)) and 0.9 < sum(shares.values()) <= 1 + 1e-12
    assert {r.vec_id for r in found} == {i for i, _ in usable(rows, 10)}


def test_no_variance(spark):
    found = whitening.table(table(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found) == [
        (i, c, 2, 0, None, None, 0.0) for i in (1, 2) for c in (1, 2)]
    some = whitening.table(table(spark, [(1, [0.5, 0.5]), (2, [0.5, 1.5])])).orderBy("vec_id", "component").collect()
    assert [abs(r.whitened) if r.whitened is not None else None for r in some] == [1.0, None, 1.0, None]


def test_too_large_for_a_long(spark):
    rows = [(i, [float((-1) ** i * 2**38)] * 3) for i in range(40)]
    found = whitening.table(table(spark, rows)).collect()
    assert {r.deviation for r in found} == {None} and abs(abs(found[0].whitened) - 1) < 1e-9


def test_empty(spark):
    assert whitening.table(table(spark, [(1, None)])).count() == 0
    assert whitening.table(table(spark, [])).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
