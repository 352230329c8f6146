"""Whitening against a dense eigendecomposition in exact and double arithmetic."""

import math

import numpy as np
import pytest

from folioscope.llm import op13_whitening as op

KIND = "vec_id long, embedding array<float>, n string, component string, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], KIND)


def check(df, rows, most=16):
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * c - t for c, t in zip(v, s)] for v in fit], dtype=float) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    got = {}
    for r in df.collect():
        got.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    k = min(most, len(s))
    assert set(got) == set(range(1, k + 1))
    for c in range(k):
        assert set(got[c + 1]) == set(x)
        sign = None
        for i, many in got[c + 1].items():
            for r in many:
                want = float(np.dot([a - t / n for a, t in zip(x[i], s)], q[:, c])) / math.sqrt(e[c])
                sign = sign or (1 if r["whitened"] * want > 0 else -1)
                assert r["whitened"] * sign == pytest.approx(want, abs=1e-6)
                assert r["n"] == n and r["deviation"] == sum((n * a - t) ** 2 for a, t in zip(x[i], s))
                assert r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-8) and r["identity_error"] < 1e-8


@pytest.mark.parametrize("dims", [5, 40, 90])
def test_against_dense(spark, dims):
    rng = np.random.default_rng(dims)
    base = rng.standard_normal((300, dims)) @ np.diag(1.5 ** -np.arange(dims).clip(0, 12) + 0.05)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000, rows[3][1]), (1000, rows[3][1]), (1001, None), (1002, [None] * dims), (1003, [math.nan] * dims), (1004, [math.inf] * dims), (1005, [])]
    check(op.whiten(table(spark, rows)), rows)


def test_flat_spectrum(spark):
    """Every direction alike: the block grows until the result is exact."""
    rng = np.random.default_rng(0)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((400, 70)) * 3)]
    check(op.whiten(table(spark, rows)), rows)


def test_exact_numbers_and_edges(spark):
    assert op.whiten(table(spark, [])).count() == 0
    assert op.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)])).count() == 0  # one distinct vector
    big = [(1, [2.0**40, 0.0]), (2, [-(2.0**41), 1.0]), (None, [3.0, 5.0]), (4, [2.0**60, 1.0]), (5, [1.0, 2.0, 3.0])]
    out = op.whiten(table(spark, big)).collect()
    assert {r["vec_id"] for r in out} == {1, 2, None} and {r["n"] for r in out} == {3} and {r["component"] for r in out} == {1}
    x = [[2**46, 0], [-(2**47), 64], [192, 320]]
    s = [sum(c) for c in zip(*x)]
    want = sum((3 * a - t) ** 2 for a, t in zip(x[2], s))
    assert next(r["deviation"] for r in out if r["vec_id"] is None) == (want if want < 2**63 else None)


def test_filter_is_the_chebyshev_polynomial():
    v = np.diag(np.linspace(0.01, 3, 12))
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((12, 4)))[0]
    got = op.filtered(lambda a: v @ a, q, v @ q, 1.0, 3.0, 6)
    t = np.polynomial.chebyshev.Chebyshev.basis(6)
    scale = t((3.0 - 0.5) / 0.5)
    assert np.allclose(got, np.diag(t((np.diag(v) - 0.5) / 0.5) / scale) @ q)
