import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.errors import PySparkException

from cohortry.llm import whitening as W

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], f"vec_id long, embedding array<{kind}>, component int, whitened double")


def by_numpy(rows, components=16):
    """(n, {row: (deviation, whitened)}, explained) by exact centring and a standard eigenvalue routine on small numbers."""
    fine = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=0)
    x = [[math.floor(64 * float(np.float32(c))) for c in v] + [0] * (width - len(v)) for _, v in fine]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums)] for r in x])
    zf = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums)] for r in fit])
    w, v = np.linalg.eigh(zf.T @ zf / n)
    order = [i for i in np.argsort(-w) if w[i] > 1e-9 * w.max()][:components]
    white = z @ v[:, order] / np.sqrt(w[order])
    dev = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    return n, [i for i, _ in fine], dev, white, w[order] / w.sum()


def check(spark, rows, kind="float"):
    n, ids, dev, white, explained = by_numpy(rows)
    got = W.whiten(frame(spark, rows, kind)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == sorted((i is None, i or 0) for i in ids)
    key = {}
    for i, d, w in zip(ids, dev, white):
        key.setdefault((i, d), []).append(w)
    signs = None
    for r in sorted(got, key=lambda r: -abs(np.array(r["whitened"])).min()):
        assert r["n"] == n and np.allclose(r["explained"], explained, rtol=1e-9) and r["identity_error"] < 1e-9
        options = key[(r["vec_id"], int(r["deviation"]))]
        if signs is None:
            signs = np.sign(options[0] * np.array(r["whitened"]))
        assert any(np.allclose(np.array(r["whitened"]) * signs, w, atol=1e-8) for w in options)
    return got


def test_as_by_a_standard_routine(spark):
    rng = np.random.default_rng(3)
    basis = rng.normal(size=(6, 20)) * np.array([[8], [5], [3], [2], [1.5], [1]])
    rows = [(i, [float(x) for x in rng.normal(size=6) @ basis + rng.normal(size=20)]) for i in range(300)]
    odd = [(300, None), (301, [NAN] + [0.0] * 19), (302, [INF] * 20), (303, [None] * 20), (None, [0.5] * 20), (5, rows[5][1]), (5, rows[6][1]), (304, rows[7][1]), (305, [1.0]), (306, [])]
    got = check(spark, [*rows, *odd])
    assert len(got) == 306 and len(got[0]["whitened"]) == 16


def test_fewer_directions_than_components(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(10)]
    got = check(spark, rows)
    assert all(len(r["whitened"]) == 1 and abs(r["explained"][0] - 1) < 1e-12 for r in got)


def test_repeated_eigenvalues_get_orthogonal_components(spark):
    corners = [[float(a), float(b), float(c)] for a in (-3, 3) for b in (-3, 3) for c in (-3, 3)]
    got = W.whiten(frame(spark, list(enumerate(corners)))).collect()
    assert all(np.allclose(r["explained"], 1 / 3, rtol=1e-12) and r["identity_error"] < 1e-12 for r in got)
    white = np.array([r["whitened"] for r in got])
    assert np.allclose(white.T @ white / 8, np.eye(3), atol=1e-12)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]], ids=["empty", "null", "no width", "one", "equal"])
def test_nothing_to_whiten(spark, rows):
    assert W.whitened_components(frame(spark, rows)).collect() == []


def test_large_numbers_stay_exact_or_stop(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(-(2**40), 2**40, 4)]) for i in range(50)]
    n, ids, dev, white, explained = by_numpy(rows)
    got = {r["vec_id"]: r for r in W.whiten(frame(spark, rows, "double")).collect()}
    assert [int(got[i]["deviation"]) for i in ids] == [
        sum((n * a - s) ** 2 for a, s in zip(r, sums)) for x in [[[math.floor(64 * c) for c in v] for _, v in rows]] for sums in [[sum(c) for c in zip(*x)]] for r in x
    ]
    assert got[0]["identity_error"] < 1e-9
    with pytest.raises(PySparkException):
        W.whiten(frame(spark, [(1, [1e300]), (2, [0.0])], "double")).collect()
    with pytest.raises(PySparkException):  # exact, but not a 64-bit number any more
        W.whitened_components(frame(spark, rows, "double")).collect()


def test_layout_changes_nothing(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(200)]
    one, many = (sorted(W.whitened_components(frame(spark, rows).repartition(k)).drop("identity_error").collect()) for k in (1, 7))
    assert [r[:4] for r in one] == [r[:4] for r in many]
    assert np.allclose([r[4:] for r in one], [r[4:] for r in many], atol=1e-12)


def test_polynomial_and_roots(spark):
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 7):
        b = rng.integers(-9, 9, (d, d + 2))
        a = (b @ b.T).tolist()
        poly = W.characteristic_polynomial(spark, a)
        for t in (-3, 0, 5):
            m = [[Fraction((t if i == j else 0) - a[i][j]) for j in range(d)] for i in range(d)]
            det = Fraction(1)
            for k in range(d):  # plain elimination in fractions
                p = next((i for i in range(k, d) if m[i][k]), None)
                if p is None:
                    det = Fraction(0)
                    break
                if p != k:
                    m[k], m[p], det = m[p], m[k], -det
                det *= m[k][k]
                for i in range(k + 1, d):
                    f = m[i][k] / m[k][k]
                    m[i] = [x - f * y for x, y in zip(m[i], m[k])]
            assert sum(c * t**i for i, c in enumerate(poly)) == det
    poly = [-4, 8, -5, 1]  # (t - 1)(t - 2)^2
    assert [W.roots_above(poly, p, 1) for p in (-1, 1, 2, 3, 4, 5)] == [3, 3, 2, 2, 0, 0]
    assert W.enclose_root(poly, 1, 5, 4)[:2] == W.enclose_root(poly, 2, 5, 4)[:2] == (31, 32)
    assert W.enclose_root(poly, 3, 5, 4)[:2] == (15, 16)


def test_primes():
    assert [p for p in range(60) if W.is_prime(p)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert W.is_prime(2**31 - 1) and not W.is_prime(25326001) and math.prod(W.primes_beyond(10**40)) > 10**40
