"""Regression, classification, curves and the tree against direct computation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.functions import tails
from cohortry.functions.columns import normal_quantile
from cohortry.operators import classify, regression, tree

X = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(11)
    x = pd.DataFrame({"x1": rng.normal(1000, 300, 500), "x2": rng.normal(0.04, 0.01, 500), "x3": rng.integers(1, 6, 500).astype(float)})
    x["y"] = 5 + 0.01 * x["x1"] - 100 * x["x2"] + x["x3"] + rng.normal(0, 2, 500)
    logit = -1 + 0.002 * (x["x1"] - 1000) + 0.5 * (x["x3"] - 3)
    x["label"] = (rng.random(500) < 1 / (1 + np.exp(-logit))).astype(int)
    return x.assign(customer_unique_id=range(500))


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).repartition(5).persist()


@pytest.fixture(scope="module")
def fit(df):
    return regression.fit_linear(df, X, "y")


def design(frame):
    return np.column_stack([np.ones(len(frame)), frame[X]])


def test_linear_fit(spark, frame, fit):
    a, y = design(frame), frame["y"].to_numpy()
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    e = y - a @ beta
    s2 = e @ e / (500 - 4)
    errors = np.sqrt(np.diag(s2 * np.linalg.inv(a.T @ a)))
    rows = regression.coefficient_table(spark, fit).collect()
    assert [r["b"] for r in rows] == pytest.approx(beta.tolist(), rel=1e-8)
    assert [r["std_error"] for r in rows] == pytest.approx(errors.tolist(), rel=1e-7)
    assert rows[1]["p"] == pytest.approx(tails.t_two_sided(beta[1] / errors[1], 496), rel=1e-6)
    reach = tails.t_critical(496)
    assert rows[2]["lower"] == pytest.approx(beta[2] - reach * errors[2], rel=1e-6)
    assert rows[1]["beta"] == pytest.approx(beta[1] * frame["x1"].std() / frame["y"].std(), rel=1e-8)
    r2 = 1 - e @ e / ((y - y.mean()) ** 2).sum()
    row = regression.fit_table(spark, fit).first()
    assert row["r_squared"] == pytest.approx(r2) and row["f"] == pytest.approx((r2 / 3) / ((1 - r2) / 496))
    ll = -250 * (math.log(2 * math.pi) + math.log(e @ e / 500) + 1)
    assert row["log_likelihood"] == pytest.approx(ll) and row["bic"] - row["aic"] == pytest.approx(4 * (math.log(500) - 2))
    assert row["condition_number"] == pytest.approx(np.linalg.cond(a), rel=1e-6)


def test_vif(spark, frame, fit):
    for i, r in enumerate(regression.vif_table(spark, fit).collect()):
        others = np.column_stack([np.ones(500), frame[[x for x in X if x != X[i]]]])
        x = frame[X[i]].to_numpy()
        left = x - others @ np.linalg.lstsq(others, x, rcond=None)[0]
        assert r["vif"] == pytest.approx(((x - x.mean()) ** 2).sum() / (left @ left), rel=1e-8)


def test_residual_statistics(spark, df, frame, fit):
    residuals = regression.with_residuals(df, fit)
    a, y = design(frame), frame["y"].to_numpy()
    e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    row = regression.residual_statistics(spark, residuals).first()
    c = e - e.mean()
    skew, kurt = (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2
    assert (row["skew"], row["kurtosis"]) == pytest.approx((skew, kurt), rel=1e-6)
    assert row["jarque_bera"] == pytest.approx(500 / 6 * (skew**2 + (kurt - 3) ** 2 / 4), rel=1e-6)
    dw = (np.diff(e) ** 2).sum() / (e @ e)
    for parts in (1, 7):
        assert regression.durbin_watson(residuals.repartition(parts)).first()[0] == pytest.approx(dw, rel=1e-9)
    hist = regression.residual_histogram(residuals).collect()
    counts, _ = np.histogram(e, bins=50)
    assert {r["bin"]: r["n"] for r in hist} == {i: n for i, n in enumerate(counts) if n}


def test_qq_positions_of_tied_residuals(spark):
    values = [3.0] * 5000 + [1.0, 2.0, 4.0]
    df = spark.createDataFrame([(v,) for v in values], "residual double")
    points = sorted((r["i"], r["residual"], r["theoretical"]) for r in regression.qq_points(df).collect())
    assert [p[0] for p in points] == list(range(1, 5004)) and [p[1] for p in points] == sorted(values)
    assert points[0][2] == pytest.approx(-points[-1][2]) and points[2501][2] == pytest.approx(0, abs=1e-12)


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-12, 1e-6, 0.01, 0.0749, 0.3, 0.5, 0.925, 0.99, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12, abs=1e-14)


def newton(a, y, w, ridge):
    beta = np.zeros(a.shape[1])
    penalty = np.diag([0.0] + [ridge] * (a.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ beta))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + penalty
        beta = beta + np.linalg.solve(h, a.T @ (w * (y - p)) - penalty @ beta)
    return beta, h


def test_logit(spark, df, frame):
    fit = classify.fit_logit(df, X, "label")
    a, y = design(frame), frame["label"].to_numpy()
    scale = np.diag([1, 1000, 0.01, 1])
    beta, h = newton(a @ np.linalg.inv(scale), y, np.ones(500), 0.0)
    beta, cov = np.linalg.inv(scale) @ beta, np.linalg.inv(scale) @ np.linalg.inv(h) @ np.linalg.inv(scale)
    assert fit.coefficients == pytest.approx(beta.tolist(), rel=1e-7)
    assert fit.standard_errors == pytest.approx(np.sqrt(np.diag(cov)).tolist(), rel=1e-6)
    p = 1 / (1 + np.exp(-a @ beta))
    row = classify.logit_fit_table(spark, fit).first()
    ll = (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    assert row["log_likelihood"] == pytest.approx(ll) and row["aic"] == pytest.approx(-2 * ll + 8)
    odds = classify.odds_table(spark, fit)
    assert odds.filter("term = 'x3'").first()["odds_ratio"] == pytest.approx(math.exp(beta[3]), rel=1e-7)
    assert {r["term"]: r["direction"] for r in classify.odds_changes(odds).collect()}["x3"] == "increase"


def test_classifier_is_the_penalised_optimum(df, frame):
    scale = classify.population_scale(df, X)
    model = classify.fit_classifier(df, scale, X, "label")
    z = (frame[X] - frame[X].mean()) / frame[X].std(ddof=0)
    y = frame["label"].to_numpy()
    w = np.where(y == 1, 500 / (2 * y.sum()), 500 / (2 * (500 - y.sum())))
    beta, _ = newton(np.column_stack([np.ones(500), z]), y, w, 1.0)
    assert [model.intercept, *model.coefficients] == pytest.approx(beta.tolist(), rel=1e-7, abs=1e-9)


def test_curves_with_ties(spark):
    rng = np.random.default_rng(2)
    score = rng.integers(0, 8, 300) / 8
    label = (rng.random(300) < 0.2 + 0.6 * score).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"score": score, "label": label})).repartition(6)
    counts = classify.curve_counts(df, "score", "label")
    pos, neg = score[label == 1], score[label == 0]
    u = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert classify.roc_auc(counts).first()[0] == pytest.approx(u / (len(pos) * len(neg)))
    points = sorted((r["fpr"], r["tpr"]) for r in classify.roc_curve(counts).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(u / (len(pos) * len(neg))) and points[0] == (0, 0) and points[-1] == (1, 1)
    cuts = sorted(set(score), reverse=True)
    best = max(cuts, key=lambda t: ((pos >= t).mean() - (neg >= t).mean(), t))
    row = classify.youden(counts).first()
    assert row["threshold"] == best and row["sensitivity"] == pytest.approx((pos >= best).mean())
    curve = [(0.0, 1.0)] + [((pos >= t).mean(), (pos >= t).sum() / (score >= t).sum()) for t in cuts]
    assert classify.pr_auc(counts).first()[0] == pytest.approx(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:])))


def test_confusion_and_report(spark):
    cells = {(0, 0): 16049, (0, 1): 11119, (1, 0): 407, (1, 1): 433}
    df = spark.createDataFrame([(a, p, n) for (a, p), n in cells.items()], "actual int, predicted int, n long")
    got = {r["class"]: r for r in classify.class_report(df).collect()}
    assert got["1"]["precision"] == pytest.approx(433 / (433 + 11119)) and got["1"]["recall"] == pytest.approx(433 / 840)
    assert got["accuracy"]["f1"] == pytest.approx((16049 + 433) / 28008) and got["macro avg"]["support"] == 28008
    one_class = spark.createDataFrame([(0, 0)], "is_repeat int, predicted int")
    zero = {r["class"]: r for r in classify.class_report(classify.confusion(one_class)).collect()}
    assert zero["1"]["precision"] == 0.0 and zero["1"]["support"] == 0


def brute_tree(x, y, depth, max_depth, min_split, min_leaf, w, number=1):
    """Every gap of every feature, recursively."""
    counts = (int((y == 0).sum()), int((y == 1).sum()))
    nodes = {number: (counts, None, None)}
    if depth == max_depth or len(y) < min_split or min(counts) == 0:
        return nodes
    best = None
    for f in range(x.shape[1]):
        gone = np.isnan(x[:, f])
        values = np.unique(x[~gone, f])
        tries = [(lo / 2 + hi / 2, missing_left) for lo, hi in zip(values, values[1:]) for missing_left in ([False, True] if gone.any() else [None])]
        for cut, missing_left in [*tries, *([(math.inf, False)] if gone.any() and len(values) else [])]:
            left = np.where(gone, bool(missing_left), x[:, f] <= cut)
            if min(left.sum(), (~left).sum()) < min_leaf:
                continue
            score = 0.0
            for side in (left, ~left):
                a, b = (y[side] == 0).sum() * w[0], (y[side] == 1).sum() * w[1]
                score += (a * a + b * b) / (a + b)
            if best is None or score > best[0] + 1e-9:
                best = (score, f, cut, left)
    if best is None:
        return nodes
    _, f, cut, left = best
    nodes[number] = (counts, f, cut)
    for side, child in ((left, 2 * number), (~left, 2 * number + 1)):
        nodes |= brute_tree(x[side], y[side], depth + 1, max_depth, min_split, min_leaf, w, child)
    return nodes


@pytest.mark.parametrize("seed", range(3))
def test_tree_with_missing_values(spark, seed):
    """All rows are trained on and predicted; missing values go where they fit better, alone if that is best."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (400, 3)).astype(float)
    y = ((x[:, 0] > 6) ^ (rng.random(400) < 0.2)).astype(int)
    x[rng.random((400, 3)) < [0.1, 0.3, 0.0]] = np.nan
    x[:, 1] = np.where((y == 1) & (rng.random(400) < 0.5), np.nan, x[:, 1])
    rows = [(*[None if np.isnan(v) else float(v) for v in r], int(c)) for r, c in zip(x, y)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, x3 double, label int")
    grown = tree.grow_tree(df, X, "label", max_depth=3, min_split=40, min_leaf=10)
    w = (400 / (2 * (y == 0).sum()), 400 / (2 * (y == 1).sum()))
    expected = brute_tree(x, y, 0, 3, 40, 10, w)
    assert {n.number: (n.counts, n.feature, n.threshold) for n in grown.nodes.values()} == expected
    leaves = {n.number: sum(n.counts) for n in grown.nodes.values() if n.feature is None}
    assert {r["leaf"]: r["count"] for r in df.groupBy(grown.node_of().alias("leaf")).count().collect()} == leaves
    assert tree.predict_tree(df, grown).count() == 400 == sum(leaves.values())


def test_tree(spark, df, frame):
    grown = tree.grow_tree(df, X, "label", max_depth=3, min_split=40, min_leaf=15)
    y = frame["label"].to_numpy()
    w = (500 / (2 * (y == 0).sum()), 500 / (2 * (y == 1).sum()))
    expected = brute_tree(frame[X].to_numpy(), y, 0, 3, 40, 15, w)
    assert {n.number: (n.counts, n.feature, n.threshold) for n in grown.nodes.values()} == {
        k: (c, f, pytest.approx(t) if t is not None else None) for k, (c, f, t) in expected.items()
    }
    assert sum(grown.importances()) == pytest.approx(1.0)
    leaves = {n.number: sum(n.counts) for n in grown.nodes.values() if n.feature is None}
    reached = df.groupBy(grown.node_of().alias("leaf")).count().collect()
    assert {r["leaf"]: r["count"] for r in reached} == leaves
    rules = tree.rule_table(spark, grown).collect()
    assert len(rules) == len(grown.nodes) and rules[0]["rule"].startswith(X[grown.nodes[1].feature])
    predicted = tree.predict_tree(df, grown).agg(F.sum("predicted")).first()[0]
    assert predicted == sum(n for leaf, n in leaves.items() if grown.weighted(grown.nodes[leaf])[1] > grown.weighted(grown.nodes[leaf])[0])


def test_tree_of_one_class(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(10)], "x double, label int")
    grown = tree.grow_tree(df, ["x"], "label", min_split=2, min_leaf=1)
    assert list(grown.nodes) == [1] and grown.importances() == [0.0]
    assert tree.predict_tree(df, grown).agg(F.min("predicted")).first()[0] == 1


def test_separated_classes_are_reported(spark):
    """A predictor that separates the classes has no finite estimate: the fit says so instead of stopping anywhere."""
    df = spark.createDataFrame([(float(i), int(i >= 20)) for i in range(40)], "x double, y int")
    with pytest.raises(classify.NotConverged, match="separate"):
        classify.fit_logit(df, ["x"], "y")
    twice = df.select("x", (F.col("x") * 2).alias("x2"), (F.col("x").cast("int") % 3 == 0).cast("int").alias("y"))
    with pytest.raises(classify.NotConverged):
        classify.fit_logit(twice, ["x", "x2"], "y")
