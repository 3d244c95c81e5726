"""Whitening against exact fractions and dense double solves; corrections on spectra that cluster."""

from fractions import Fraction

import numpy as np
import pytest

from lorewell.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n string, component string, _id string, _v string"
RNG = np.random.default_rng(7)


def orthogonal(d):
    q = np.linalg.qr(RNG.normal(size=(d, d)))[0].astype(whitening.WIDE)
    for _ in range(4):
        q = q + q @ (np.eye(d) - q.T @ q) / 2
    return q


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1, 33) / 32,
        1 + 1e-9 * np.arange(24),  # float32 sees one eigenvalue
        [5, 5 - 1e-8, 5 - 2e-8, 3, 3, 2] + [1 - 1e-10 * k for k in range(20)],  # clusters, one of them exact
        [1, 1, 1 + 1e-15, 0.5] + [0] * 8,
        np.exp(-np.arange(40.0)),
        [4],
        [0, 0, 0],
    ],
)
def test_corrections(values):
    d = len(values)
    q = orthogonal(d)
    a = (q * np.array(values, whitening.WIDE)) @ q.T
    a = (a + a.T) / 2
    lam, x = whitening.refined(a)
    size = max(float(np.abs(values).max()), 1e-300)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-17 * d
    assert np.abs(a @ x - x * lam).max() < 1e-17 * d * size
    assert np.abs(lam - np.sort(np.array(values, whitening.WIDE))[::-1]).max() < 1e-17 * d * size
    order = np.argsort(-np.array(values), kind="stable")
    for k, i in enumerate(order):
        gap = min((abs(values[i] - v) for j, v in enumerate(values) if j != i), default=size)
        if gap > 1e-10 * size:  # its direction is one
            assert 1 - abs(float(x[:, k] @ q[:, i])) < (1e-17 * d * size / gap) ** 2 + 1e-17


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["c"] * 5) for i, v in rows], SCHEMA).repartition(4)


def floats(m):
    return [[float(np.float32(v)) for v in row] for row in m]


def check(spark, rows, d):
    out = whitening.whiten(frame(spark, rows))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    good = [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in good], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, s = len(fit), fit.sum(0)
    mean = np.array([float(Fraction(int(v), n)) for v in s])
    centred = fit.astype(float) - mean
    cov = centred.T @ centred / n
    lam, vec = np.linalg.eigh(cov)
    got = {}
    for r in out.collect():
        got.setdefault((r.component, r.vec_id), []).append(r)
    k_max = max(k for k, _ in got)
    assert sum(map(len, got.values())) == len(good) * k_max
    for k in range(1, k_max + 1):
        e, v = lam[-k], vec[:, -k]
        want = (x.astype(float) - mean) @ v / np.sqrt(e)
        pairs = {}
        for (i, _), w, row in zip(good, want, x):
            pairs.setdefault(i, []).append((float(w), sum((n * a - b) ** 2 for a, b in zip(row, s))))
        flat_want, flat_got = [], []
        for i, found in pairs.items():
            rows_k = sorted(got[k, i], key=lambda r: (r.deviation, r.whitened))
            assert sorted(r.deviation for r in rows_k) == sorted(p[1] for p in found)
            assert {r.n for r in rows_k} == {n} and max(r.identity_error for r in rows_k) < 1e-9
            assert abs(rows_k[0].explained - e / np.trace(cov)) < 1e-9 * rows_k[0].explained
            if len(found) == 1:
                flat_want.append(found[0][0])
                flat_got.append(rows_k[0].whitened)
        a, b = np.array(flat_want), np.array(flat_got)
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    return k_max


def test_all_rows(spark):
    m = floats(RNG.normal(size=(300, 6)) * [3, 2, 1.5, 1, 0.5, 0.2] + 0.3)
    rows = list(enumerate(m)) + [(k, m[0]) for k in range(400, 600)]  # a very common vector
    rows += [(0, m[5]), (None, m[6]), (None, m[7]), (700, None), (701, [None] * 6), (702, [0.0] * 5 + [None])]
    rows += [(703, [float("nan")] * 6), (704, [0.1] * 5 + [float("-inf")]), (705, []), (706, [1.0, 2.0])]
    assert check(spark, rows, 6) == 4


def test_few_directions_and_small_tables(spark):
    line = [(k, [0.5 * k, -0.0, 1.0]) for k in range(20)]
    assert check(spark, line, 3) == 1  # one direction alone has variance
    assert check(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.5]), (3, [0.0, 0.0])], 2) == 2
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3, [(1, [])], [(1, [1.0]), (2, [1.0001])]):
        assert whitening.whiten(frame(spark, rows)).count() == 0


def test_large_entries(spark):
    m = floats(RNG.normal(size=(50, 3)) * [1e9, 1e7, 1e5])
    out = whitening.whiten(frame(spark, list(enumerate(m)))).collect()
    assert len(out) == 150 and max(r.identity_error for r in out) < 1e-6
    huge = [(k, [3e38 * (-1) ** k, float(k), 0.0]) for k in range(10)]
    out = whitening.whiten(frame(spark, huge)).collect()
    assert out and all(r.deviation is None for r in out)


def test_products_are_exact():
    for top in (3, 1 << 20, 1 << 26, 1 << 40, 1 << 53):
        y = RNG.integers(-top, top + 1, (40, 3))
        wide = y.astype(object)
        assert (whitening.products(y) == wide.T @ wide).all()
