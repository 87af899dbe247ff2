"""Group comparisons and correlation against direct computation."""

import math

import numpy as np
import pandas as pd
import pytest

from cohortry.operators import anova, charts, correlation, summaries


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    g = rng.choice(["a", "b", "c", "d"], 400, p=[0.7, 0.15, 0.1, 0.05])
    r = rng.integers(0, 2, 400)
    r[g == "d"] = 1  # one empty cell
    y = rng.normal(50, 9, 400).round(0) + (g == "b") * 6 + r * 2
    return pd.DataFrame({"g": g, "r": r, "y": np.where(rng.random(400) < 0.03, np.nan, y)})


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "g string, r int, y double")


def sums(groups):
    everything = np.concatenate(groups)
    between = sum(len(x) * (x.mean() - everything.mean()) ** 2 for x in groups)
    within = sum(((x - x.mean()) ** 2).sum() for x in groups)
    return between, within, len(groups), len(everything)


def test_one_way(df, frame):
    row = anova.one_way(df, "g", "y").first()
    between, within, k, n = sums([x["y"].dropna().to_numpy() for _, x in frame.groupby("g")])
    assert row["f"] == pytest.approx((between / (k - 1)) / (within / (n - k)))
    assert row["eta_squared"] == pytest.approx(between / (between + within))
    assert row["ss_between"] + row["ss_within"] == pytest.approx(frame["y"].var(ddof=0) * n)
    assert (row["n"], row["df_between"], row["df_within"]) == (n, 3, n - 4)


def test_levene(df, frame):
    row = anova.levene(df, "g", "y").first()
    between, within, k, n = sums([(x["y"] - x["y"].median()).abs().dropna().to_numpy() for _, x in frame.groupby("g")])
    assert row["w"] == pytest.approx((between / (k - 1)) / (within / (n - k)))


def test_kruskal(df, frame):
    row = anova.kruskal(df, "g", "y").first()
    known = frame.dropna()
    rank, n = known["y"].rank(), len(known)
    h = 12 / (n * (n + 1)) * sum(rank[x.index].sum() ** 2 / len(x) for _, x in known.groupby("g")) - 3 * (n + 1)
    ties = known["y"].value_counts()
    assert row["h"] == pytest.approx(h / (1 - (ties**3 - ties).sum() / (n**3 - n)))
    assert row["df"] == 3


def test_tukey(df, frame):
    pairs = {(r["group1"], r["group2"]): r for r in anova.tukey(df, "g", "y").collect()}
    known = frame.dropna()
    _, within, k, n = sums([x["y"].to_numpy() for _, x in known.groupby("g")])
    means, counts = known.groupby("g")["y"].mean(), known.groupby("g")["y"].count()
    assert len(pairs) == 6
    for (a, b), row in pairs.items():
        se = math.sqrt(within / (n - k) / 2 * (1 / counts[a] + 1 / counts[b]))
        assert row["mean_diff"] == pytest.approx(means[b] - means[a])
        assert row["q"] == pytest.approx(abs(means[b] - means[a]) / se)
        assert row["reject"] == (row["p_adj"] < 0.05) == (row["lower"] > 0 or row["upper"] < 0)


def test_tukey_gate(spark):
    same = spark.createDataFrame([(g, float(v)) for g in "abc" for v in (1, 2, 3)], "g string, y double")
    apart = spark.createDataFrame([(g, float(v) + 50 * i) for i, g in enumerate("abc") for v in (1, 2, 3)], "g string, y double")
    assert anova.tukey_if_significant(same, "g", "y").count() == 0
    gated = anova.tukey_if_significant(apart, "g", "y")
    rejected = anova.rejected_pairs(gated, 2).collect()
    assert gated.count() == 3 and [(r["rejected"], r["pairs"]) for r in rejected] == [(3, 3)] * 2
    assert anova.rejected_pairs(anova.tukey(same, "g", "y")).count() == 0


def test_factors_with_too_many_levels_are_refused(spark, monkeypatch):
    df = spark.range(60).selectExpr("cast(id % 12 as string) g", "cast(id % 5 as string) h", "cast(id as double) y")
    assert anova.tukey(df, "g", "y").count() == 66 and anova.two_way(df, "g", "h", "y").count() == 4
    monkeypatch.setattr(anova, "MOST_LEVELS", 11)
    with pytest.raises(Exception, match="more than 11 levels"):
        anova.tukey(df, "g", "y").collect()
    monkeypatch.setattr(anova, "MOST_CELLS", 59)
    with pytest.raises(Exception, match="more than 59 cells"):
        anova.two_way(df, "g", "h", "y").collect()


def residual_ss(design, y):
    return float(((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2).sum())


def test_two_way_with_an_empty_cell(df, frame):
    """Type II sums from nested models over the rows themselves; the interaction loses a degree of freedom."""
    known = frame.dropna()
    y = known["y"].to_numpy()
    one = np.ones((len(known), 1))
    a, b = (pd.get_dummies(known[c], dtype=float).to_numpy() for c in ("r", "g"))
    cells = pd.get_dummies(known["r"].astype(str) + known["g"], dtype=float).to_numpy()
    ss = {name: residual_ss(np.hstack(parts), y) for name, parts in {
        "a": [one, a], "b": [one, b], "ab": [one, a, b], "full": [cells]}.items()}
    got = {r["effect"]: r for r in anova.two_way(df, "r", "g", "y").collect()}
    assert got["r"]["sum_sq"] == pytest.approx(ss["b"] - ss["ab"], rel=1e-6) and got["r"]["df"] == 1
    assert got["g"]["sum_sq"] == pytest.approx(ss["a"] - ss["ab"], rel=1e-6) and got["g"]["df"] == 3
    assert got["r:g"]["sum_sq"] == pytest.approx(ss["ab"] - ss["full"], rel=1e-6) and got["r:g"]["df"] == 2
    assert got["residual"]["sum_sq"] == pytest.approx(ss["full"]) and got["residual"]["df"] == len(known) - 7
    assert got["r"]["f"] == pytest.approx((ss["b"] - ss["ab"]) / (ss["full"] / (len(known) - 7)), rel=1e-6)


def test_chi2_with_an_empty_cell(df, frame):
    table = pd.crosstab(frame["r"], frame["g"]).to_numpy()
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    row = anova.chi2_independence(df, "r", "g").first()
    assert row["chi2"] == pytest.approx(((table - expected) ** 2 / expected).sum()) and row["df"] == 3
    assert row["cramers_v"] == pytest.approx(math.sqrt(row["chi2"] / table.sum()))
    assert anova.contingency(df, "r", "g").count() == 8


def test_chi2_of_two_by_two_is_corrected(spark):
    cells = {(0, "x"): 12, (0, "y"): 5, (1, "x"): 7, (1, "y"): 9}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "r int, g string")
    table = np.array([[12, 5], [7, 9]])
    expected = np.outer(table.sum(1), table.sum(0)) / 33
    row = anova.chi2_independence(df, "r", "g").first()
    assert row["df"] == 1 and row["chi2"] == pytest.approx(((abs(table - expected) - 0.5) ** 2 / expected).sum())


def test_describe_single_row_and_null_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0), (None, 9.0), ("c", None)], "g string, y double")
    got = {r["g"]: (r["n"], r["mean"], r["sd"]) for r in summaries.describe(df, ["g"], "y").collect()}
    assert got["a"] == (1, 1.0, None) and got["b"] == (2, 3.0, pytest.approx(math.sqrt(2)))
    assert got["c"][0] == 0 and None not in got


def test_top_levels_break_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "g string")
    assert [r["g"] for r in summaries.top_levels(df, "g", 2).collect()] == ["c", "a"]
    assert {r["g"] for r in summaries.restrict_to_top(df, "g", 2).collect()} == {"c", "a"}


def test_box_stats(df, frame):
    got = {r["g"]: r for r in charts.box_stats(df, ["g"], "y").collect()}
    for g, x in frame.dropna().groupby("g"):
        q1, m, q3 = x["y"].quantile([0.25, 0.5, 0.75])
        inside = x["y"].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        row = got[g]
        assert (row["q1"], row["median"], row["q3"]) == pytest.approx((q1, m, q3))
        assert (row["whisker_low"], row["whisker_high"]) == (x["y"][inside].min(), x["y"][inside].max())
        assert row["outliers"] == (~inside).sum() and row["n"] == len(x)


@pytest.fixture(scope="module")
def features():
    rng = np.random.default_rng(5)
    data = pd.DataFrame({n: rng.integers(0, 9, 300).astype(float) for n in correlation.CORRELATED})
    data["total_spent"] += data["avg_order_value"] * 2
    for n in ("avg_freight_ratio", "avg_review_score", "avg_order_value"):
        data.loc[rng.random(300) < 0.1, n] = np.nan
    data.loc[data["avg_freight_ratio"].isna(), "avg_item_count"] = np.nan  # missing together
    return data.assign(customer_unique_id=range(300))


def test_null_scopes(spark, features):
    df = spark.createDataFrame(features.astype(object).where(features.notna(), None), ", ".join(f"{n} double" for n in correlation.CORRELATED) + ", customer_unique_id long")
    found = correlation.null_scopes(df, correlation.CORRELATED)
    assert {n: o for n, o in found.items() if o} == {
        "avg_freight_ratio": "avg_freight_ratio", "avg_item_count": "avg_freight_ratio", "avg_review_score": "avg_review_score", "avg_order_value": "avg_order_value",
    }


@pytest.mark.parametrize("method, build", [("pearson", correlation.pearson_matrix), ("spearman", correlation.spearman_matrix)])
@pytest.mark.parametrize("part", [1000, 20])
def test_correlation_is_pairwise_complete(spark, features, method, build, part, monkeypatch):
    monkeypatch.setattr(correlation, "COMMON", part)  # values are common, or some of them
    names = correlation.CORRELATED
    df = spark.createDataFrame(features.astype(object).where(features.notna(), None), ", ".join(f"{n} double" for n in names) + ", customer_unique_id long")
    got = {(r["var_x"], r["var_y"]): r["r"] for r in build(df).collect()}
    assert len(got) == 64
    for x in names:
        for y in names:
            both = features[[x, y]].dropna()
            both = both.rank() if method == "spearman" else both
            expected = 1.0 if x == y else np.corrcoef(both[x], both[y])[0, 1]
            assert got[x, y] == pytest.approx(expected, abs=1e-12)


def test_pearson_target_order_and_marks(spark, features):
    df = spark.createDataFrame(features.astype(object).where(features.notna(), None), ", ".join(f"{n} double" for n in correlation.CORRELATED) + ", customer_unique_id long")
    rows = correlation.pearson_target(df, "avg_order_value").collect()
    assert rows[0]["variable"] == "total_spent" and rows[0]["mark"] == "***"
    assert [abs(r["r"]) for r in rows] == sorted((abs(r["r"]) for r in rows), reverse=True)
