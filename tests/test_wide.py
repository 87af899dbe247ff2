"""Models of sixty predictors: their sums pass the fields of generated code and are formed as blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import classify, regression

K, N = 60, 4000
NAMES = [f"x{i}" for i in range(K)]


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, K)) * rng.uniform(0.1, 30, K) + rng.uniform(-1000, 1000, K)
    z = (x - x.mean(0)) / x.std(0)
    slopes = rng.normal(size=K) * 0.15
    label = (rng.random(N) < 1 / (1 + np.exp(-(z @ slopes - 0.4)))).astype(float)
    return x, z, 3 + z @ slopes + rng.normal(size=N), label


@pytest.fixture(scope="module")
def wide(spark, arrays):
    x, _, y, label = arrays
    rows = [(*map(float, r), float(a), int(b)) for r, a, b in zip(x, y, label)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in NAMES) + ", y double, label int").repartition(7)


def newton(z, y, w, penalty):
    a, beta = np.column_stack([np.ones(len(z)), z]), np.zeros(z.shape[1] + 1)
    ridge = np.diag([0.0] + [penalty] * z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-a @ beta))
        information = (a * (w * p * (1 - p))[:, None]).T @ a
        beta += np.linalg.solve(information + ridge, a.T @ (w * (y - p)) - ridge @ beta)
    return beta, information


def test_linear_fit(spark, wide, arrays):
    x, _, y, _ = arrays
    holes = wide.unionByName(wide.limit(3).withColumn("x7", F.lit(None).cast("double")))
    fit = regression.fit_linear(holes, NAMES, "y")
    assert fit.n == N
    assert np.allclose(fit.cov, np.cov(np.column_stack([x, y]).T), rtol=1e-9, atol=1e-12)
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones(N), x]), y, rcond=None)
    assert [r["b"] for r in regression.coefficient_table(spark, fit).collect()] == pytest.approx(want.tolist(), rel=1e-6)


def test_logistic_fit(wide, arrays):
    x, z, _, label = arrays
    beta, information = newton(z, label, np.ones(N), 0.0)
    fit = classify.fit_logit(wide, NAMES, "label")
    assert fit.coefficients[1:] == pytest.approx((beta[1:] / x.std(0)).tolist(), rel=1e-7)
    assert fit.standard_errors[1:] == pytest.approx((np.sqrt(np.diag(np.linalg.inv(information)))[1:] / x.std(0)).tolist(), rel=1e-7)


def test_penalised_models_share_the_pass(wide, arrays):
    """Three models on overlapping rows with weights of their own."""
    x, z, _, label = arrays
    scale = classify.population_scale(wide, NAMES)
    part = F.when(F.col("x0") > float(np.median(x[:, 0])), F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))
    weight = F.array(F.lit(1.0), F.lit(2.0), F.when(F.col("label") == 1, 1.5).otherwise(0.5))
    fits = classify.newton_fits(wide, [scale.z(c) for c in NAMES], "label", 3, part, weight, penalty=2.0)
    up = x[:, 0] > np.median(x[:, 0])
    for (beta, _, _), rows, w in zip(fits, (up, ~up, np.ones(N, bool)), (np.ones(N), np.full(N, 2.0), np.where(label == 1, 1.5, 0.5))):
        assert beta == pytest.approx(newton(z[rows], label[rows], w[rows], 2.0)[0], rel=1e-6, abs=1e-8)


def test_blocks_agree_with_the_sums(wide, monkeypatch):
    some = NAMES[:4]
    sums, linear = classify.fit_logit(wide, some, "label"), regression.fit_linear(wide, some, "y")
    for module in (classify, regression):
        monkeypatch.setattr(module, "MOST_SUMS", 1)
    blocks = classify.fit_logit(wide, some, "label")
    assert blocks.coefficients == pytest.approx(sums.coefficients, rel=1e-9) and blocks.log_likelihood == pytest.approx(sums.log_likelihood, rel=1e-12)
    assert np.allclose(regression.fit_linear(wide, some, "y").cov, linear.cov, rtol=1e-10)
