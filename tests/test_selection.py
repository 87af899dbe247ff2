"""Selection near the quantiles, bounds of the tree search, the reduced curve, sampled hold-outs, co-moments."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.operators import charts, classify, correlation, ranks, splits, tree


@pytest.fixture(scope="module")
def big(spark):
    """100,000 rows, nearly all values distinct, a third of them in one group, and one value of a fifth of another group."""
    rng = np.random.default_rng(11)
    g = np.where(rng.random(100_000) < 0.33, 0, rng.integers(1, 8, 100_000))
    v = np.where((g == 3) & (rng.random(100_000) < 0.2), 1.5, rng.lognormal(0, 2, 100_000))
    return pd.DataFrame({"g": g, "v": v})


SHARES = {"q1": 0.25, "m": 0.5, "q9": 0.999, "least": 0.0, "most": 1.0}


def test_selection_is_exact(spark, big):
    df = spark.createDataFrame(big).repartition(6)
    got = {r["g"]: r for r in ranks.exact_quantiles(df, ["g"], "v", SHARES).collect()}
    for g, part in big.groupby("g"):
        want = part["v"].quantile(list(SHARES.values())).tolist()
        assert [got[g][c] for c in SHARES] == pytest.approx(want, rel=1e-12) and got[g]["n"] == len(part)


def test_only_rows_near_a_quantile_are_put_in_order(spark, big, monkeypatch):
    seen, own = [], ranks.bracketed_rows

    def counted(*a):
        rows = own(*a)
        seen.append(rows.count())
        return rows

    monkeypatch.setattr(ranks, "bracketed_rows", counted)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    ranks.exact_quantiles(spark.createDataFrame(big[big["g"] != 3]), ["g"], "v", {"q1": 0.25, "m": 0.5, "q3": 0.75}).collect()
    assert 0 < seen[0] < 0.01 * len(big)


@pytest.mark.parametrize("wrong", [[1e9, 2e9], [-2.0, -1.0], [1.0, 1.0]], ids=["above", "below", "empty"])
@pytest.mark.parametrize("keys", [[], ["g"]], ids=["whole", "groups"])
def test_a_wrong_sketch_costs_time_only(spark, big, monkeypatch, wrong, keys):
    own = ranks.keep

    def misled(df):
        return own(df.withColumn("_q", F.lit(wrong)) if "_q" in df.columns else df)

    monkeypatch.setattr(ranks, "keep", misled)
    small = big[:5000]
    rows = ranks.exact_quantiles(spark.createDataFrame(small), keys, "v", {"m": 0.5}).collect()
    want = small.groupby("g")["v"].median().tolist() if keys else [small["v"].median()]
    assert sorted(r["m"] for r in rows) == pytest.approx(sorted(want), rel=1e-12)


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 5.0), ("b", None), ("c", 2.0), ("c", 4.0)], "g string, v double")
    assert {r["g"]: (r["n"], r["m"]) for r in ranks.exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()} == {"a": (1, 1.0), "c": (2, 3.0)}
    assert ranks.exact_quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0
    empty = ranks.exact_quantiles(df.limit(0), [], "v", {"m": 0.5}).first()
    assert empty["m"] is None and not empty["n"]


def test_box_statistics(spark, big):
    got = {r["g"]: r for r in charts.box_stats(spark.createDataFrame(big), ["g"], "v").collect()}
    for g, part in big.groupby("g"):
        q1, m, q3 = part["v"].quantile([0.25, 0.5, 0.75])
        inside = part["v"].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        assert (got[g]["n"], got[g]["outliers"]) == (len(part), (~inside).sum())
        assert [got[g][c] for c in ("q1", "median", "q3", "whisker_low", "whisker_high")] == pytest.approx(
            [q1, m, q3, part["v"][inside].min(), part["v"][inside].max()], rel=1e-12
        )


# --- tree --------------------------------------------------------------------------------------------------------------


def test_bounds_close_most_ranges(spark):
    rng = np.random.default_rng(3)
    n = 40_000
    frame = pd.DataFrame({f"x{i}": rng.normal(size=n) for i in range(5)})
    frame["label"] = (rng.random(n) < 1 / (1 + np.exp(-3 * frame["x0"] + (frame["x2"] > 0.3)))).astype(int)
    df, xs = spark.createDataFrame(frame), [f"x{i}" for i in range(5)]
    sizes = {1: (int((frame["label"] == 0).sum()), int(frame["label"].sum()))}
    weights = tuple(n / (2 * c) for c in sizes[1])
    limits = ranks.numeric_limits(df, xs, math.isqrt(n))
    placed = ranks.stack(df.withColumn("node", F.lit(1)), xs, ["node", "label"]).withColumn("_range", ranks.stacked_range(limits, xs))
    ranges = tree.keep(tree.ranged_counts(placed, "label", sizes))
    opened = tree.open_ranges(ranges, weights, 50)
    rows = placed.join(opened, ["node", "feature", "_range"]).count()
    assert ranges.count() <= 5 * 201 and 0 < rows < 0.03 * 5 * n
    gaps = ranges.drop("least").unionByName(tree.inner_gaps(placed, opened, "label"))
    best = tree._best_splits(gaps, weights, 50).first()
    x, y = frame["x0"].to_numpy(), frame["label"].to_numpy()
    order = np.argsort(x)
    ones = np.cumsum(y[order])[:-1] * weights[1]
    zeros = np.cumsum(1 - y[order])[:-1] * weights[0]
    t0, t1 = n / 2, n / 2
    purity = (zeros**2 + ones**2) / (zeros + ones) + ((t0 - zeros) ** 2 + (t1 - ones) ** 2) / (n - zeros - ones)
    at = purity.argmax()
    assert best["feature"] == 0 and best["cut"] == pytest.approx((x[order][at] + x[order][at + 1]) / 2, rel=1e-12)


def test_the_bound_holds_inside_every_range(spark):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"node": 1, "feature": 0, "value": rng.integers(0, 400, 600).astype(float)})
    frame["label"] = (rng.random(600) < np.where(frame["value"] > 130, 0.9, 0.15)).astype(int)
    frame["_range"] = (frame["value"] // 40).astype(int)
    missing = (7, 19)
    sizes = {1: (int((frame["label"] == 0).sum()) + missing[0], int(frame["label"].sum()) + missing[1])}
    weights = (1.3, 0.8)
    ranges = tree.ranged_counts(spark.createDataFrame(frame), "label", sizes)
    closed = set(range(10)) - {r["_range"] for r in tree.open_ranges(ranges, weights, 1).collect()}

    def purity(c0, c1):
        return sum(((a * weights[0]) ** 2 + (b * weights[1]) ** 2) / (a * weights[0] + b * weights[1]) for a, b in ((c0, c1), (sizes[1][0] - c0, sizes[1][1] - c1)))

    best = {}
    for v in sorted(frame["value"].unique())[:-1]:
        left = frame[frame["value"] <= v]
        c = ((left["label"] == 0).sum(), left["label"].sum())
        at = int(v // 40)
        inner = frame[(frame["_range"] == at)]["value"].max() != v
        score = max(purity(*c), purity(c[0] + missing[0], c[1] + missing[1]))
        best.setdefault((at, inner), []).append(score)
    border = max(max(s) for (_, inner), s in best.items() if not inner)
    assert closed and all(max(best.get((r, True), [0])) <= border + 1e-9 for r in closed)


# --- curve -------------------------------------------------------------------------------------------------------------


def library_rule(fps, tps):
    """Kept points of a curve: the ends, and where the second difference of either count is not 0."""
    inner = (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0)
    return np.concatenate([[True], inner, [True]]) if len(fps) > 2 else np.ones(len(fps), bool)


@pytest.mark.parametrize("levels", [7, 60, 100_000])
def test_polyline(spark, levels):
    rng = np.random.default_rng(levels)
    score = rng.integers(0, levels, 3000) / 8
    frame = pd.DataFrame({"score": score, "is_repeat": (rng.random(3000) < score / score.max()).astype(int)})
    counts = classify.curve_counts(spark.createDataFrame(frame).repartition(5), following=True)
    by = frame.groupby("score")["is_repeat"].agg(["sum", "count"]).sort_index(ascending=False)
    tps, fps = by["sum"].cumsum().to_numpy(), (by["count"] - by["sum"]).cumsum().to_numpy()
    kept = library_rule(fps, tps)
    got = sorted((r["fpr"], r["tpr"]) for r in classify.roc_polyline(counts).collect())
    np.testing.assert_allclose(got, sorted([(0.0, 0.0), *zip(fps[kept] / fps[-1], tps[kept] / tps[-1])]), rtol=1e-12)
    straight = sorted((r["fpr"], r["tpr"]) for r in classify.roc_polyline(counts, straight=True).collect())
    x, y = np.array(straight).T
    area = float(((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2).sum())
    assert area == pytest.approx(classify.roc_auc(counts).first()["roc_auc"], abs=1e-12) and len(straight) <= len(got)
    turns = np.diff(x)[:-1] * np.diff(y)[1:] - np.diff(y)[:-1] * np.diff(x)[1:]
    assert (np.abs(turns) > 1e-15).all()  # no point is left on a line


def test_polyline_of_a_straight_curve(spark):
    df = spark.createDataFrame([(float(s), y) for s in range(50) for y in (0, 1)], "score double, is_repeat int")
    counts = classify.curve_counts(df, following=True)
    assert sorted((r["fpr"], r["tpr"]) for r in classify.roc_polyline(counts, straight=True).collect()) == [(0.0, 0.0), (1.0, 1.0)]
    assert classify.roc_polyline(counts).count() == 3  # the highest score stays


# --- hold-out ----------------------------------------------------------------------------------------------------------


def test_sampled_holdout(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 50 == 1, 1).when(F.col("id") % 50 == 2, None).otherwise(0).alias("y"))
    marked = splits.sampled_holdout(df, "k", "y", {0: 30, 1: 60})
    assert "Exchange" not in marked._jdf.queryExecution().executedPlan().toString()
    shares = {r["y"]: r for r in splits.sample_shares(marked, "y").collect()}
    for level, percent in ((0, 30), (1, 60)):
        assert abs(shares[level]["percent"] - percent) < 5 * shares[level]["percent_sd"]
    assert shares[None]["test_n"] == 0
    again = splits.sampled_holdout(df.repartition(9), "k", "y", {0: 30, 1: 60})
    assert sorted(r["k"] for r in marked.filter("is_test = 1").collect()) == sorted(r["k"] for r in again.filter("is_test = 1").collect())
    assert splits.sampled_holdout(spark.createDataFrame([(None,)], "k long"), "k", percent=100).first()["is_test"] == 0
    assert splits.sampled_holdout(df, "k", percent=100).filter("is_test = 0").count() == splits.sampled_holdout(df, "k", percent=0).filter("is_test = 1").count() == 0


# --- co-moments --------------------------------------------------------------------------------------------------------


def test_comoments_by_pattern(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame(rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) + 1e6, columns=list("abcde"))
    for i, c in enumerate("abc"):
        frame.loc[rng.random(500) < 0.2 * (i + 1), c] = None
    frame["k"], frame["o"] = 0.1, None
    rows = [tuple(None if pd.isna(x) else float(x) for x in r) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame)).repartition(7)
    pairs = [(x, y) for i, x in enumerate(frame) for y in list(frame)[:i]]
    got = {(r["x"], r["y"]): r for r in correlation.comoments(df, pairs).collect()}
    assert len(got) == len(pairs)
    for x, y in pairs:
        both = frame[[x, y]].astype(float).dropna()
        assert got[x, y]["n"] == len(both)
        if "k" in (x, y) or "o" in (x, y):
            assert got[x, y]["r"] is None
        else:
            assert got[x, y]["r"] == pytest.approx(both[x].corr(both[y]), abs=1e-9)
    plan = correlation.comoments(df, pairs)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
