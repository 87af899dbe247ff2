"""Order statistics against direct computation, whatever the partitioning."""

import bisect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.operators import ranks, splits


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    values = np.where(rng.random(600) < 0.4, 5.0, rng.normal(0, 10, 600).round(1))  # one value holds 40 % of the rows
    return pd.DataFrame({"id": [f"k{i:04d}" for i in range(600)], "g": rng.choice(["a", "b", "c"], 600, p=[0.8, 0.15, 0.05]), "v": values})


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_quantiles(spark, frame, parts):
    df = spark.createDataFrame(frame).repartition(parts)
    got = {r["g"]: r for r in ranks.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "p": 0.9}).collect()}
    for g, rows in frame.groupby("g"):
        assert [got[g][c] for c in ("q1", "m", "p")] == pytest.approx(rows["v"].quantile([0.25, 0.5, 0.9]).tolist())
    whole = ranks.exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert whole["m"] == pytest.approx(frame["v"].median()) and whole["n"] == 600


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert ranks.exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] is None


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_average_ranks(spark, frame, parts):
    df = spark.createDataFrame(frame).repartition(parts)
    placed = ranks.value_positions(df, [], "v").withColumn("rank", ranks.average_rank(F.col("n_before"), F.col("n")))
    got = {r["v"]: r["rank"] for r in placed.collect()}
    expected = frame["v"].rank()
    assert [got[v] for v in frame["v"]] == expected.tolist()
    assert sum(r["rank"] * r["n"] for r in placed.collect()) == 600 * 601 / 2


def test_following_value(spark, frame):
    df = spark.createDataFrame(frame)
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    limits = ranks.numeric_limits(df, ["v"])["v"]
    rows = ranks.running_totals(counts, ["g"], "v", ["n"], ranks.range_of(F.col("v"), limits), following=True).collect()
    for g, part in frame.groupby("g"):
        values = sorted(part["v"].unique())
        got = {r["v"]: r["v_next"] for r in rows if r["g"] == g}
        assert got == dict(zip(values, [*values[1:], None]))


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_positions_by_key(spark, frame, parts):
    df = spark.createDataFrame(frame).repartition(parts)
    bucket = ranks.range_of(F.col("id"), ranks.key_limits(df, "id"))
    got = {r["id"]: (r["position"], r["class_n"]) for r in splits.positions(df, ["g"], ["id"], bucket).collect()}
    for _, rows in frame.groupby("g"):
        for i, key in enumerate(sorted(rows["id"]), 1):
            assert got[key] == (i, len(rows))


def test_holdout_is_exact_and_repeatable(spark, frame):
    df = spark.createDataFrame(frame)
    one = {r["id"]: r["is_test"] for r in splits.holdout(df.repartition(3), "id").collect()}
    two = {r["id"]: r["is_test"] for r in splits.holdout(df.repartition(11), "id").collect()}
    assert one == two and sum(one.values()) == 180


def test_stratified_quota_sizes(spark):
    """The published split: 90,556 and 2,801 rows give 27,168 and 840 held-out rows, 28,008 together."""
    df = spark.range(93357).select(F.col("id").alias("k"), (F.col("id") < 2801).cast("int").alias("y"))
    got = {r["y"]: r["n"] for r in splits.holdout(df, "k", "y").filter("is_test = 1").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 27168, 1: 840}


def _deal(labels, folds=5):
    """Sorted classes dealt round-robin, blocks in row order."""
    order = list(dict.fromkeys(labels))
    codes = sorted(order.index(x) for x in labels)
    take = [[codes[i::folds].count(c) for c in range(len(order))] for i in range(folds)]
    blocks = {c: [f for f in range(folds) for _ in range(take[f][c])] for c in range(len(order))}
    seen = {c: 0 for c in range(len(order))}
    out = []
    for x in labels:
        c = order.index(x)
        out.append(blocks[c][seen[c]])
        seen[c] += 1
    return out


@pytest.mark.parametrize("n, share", [(203, 0.3), (57, 0.8), (600, 0.03)])
def test_folds(spark, n, share):
    rng = np.random.default_rng(n)
    labels = (rng.random(n) < share).astype(int).tolist()
    df = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "k long, y int").repartition(5)
    got = {r["k"]: r["fold"] for r in splits.stratified_folds(df, "y", "k").collect()}
    assert [got[i] for i in range(n)] == _deal(labels)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 1000])
def test_ranges_by_halving(spark, n):
    limits = sorted({float(x) for x in np.random.default_rng(n).normal(size=n).round(3)})
    values = [-9.0, 9.0, 0.0, *limits[:50], *np.random.default_rng(1).normal(size=50)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    for r in df.select("v", ranks.range_of(F.col("v"), limits).alias("at")).collect():
        assert r["at"] == (0 if r["v"] is None else bisect.bisect_left(limits, r["v"]))
    assert len(ranks._halvings(len(limits))) <= 10  # comparisons for up to a thousand limits
    keys = sorted({f"k{int(x * 1000):05d}" for x in np.random.default_rng(2).random(n)})
    texts = spark.createDataFrame([(k,) for k in [*keys[:40], "a", "z", "k00500x"]], "k string")
    for r in texts.select("k", ranks.range_of(F.col("k"), keys).alias("at")).collect():
        assert r["at"] == bisect.bisect_left(keys, r["k"])


def test_stacked_ranges(spark):
    limits = {"a": [1.0, 2.0, 3.0], "b": [], "c": [0.0]}
    df = spark.createDataFrame([(0, 2.0), (0, 2.5), (0, 9.0), (1, 5.0), (2, 0.0), (2, 0.1)], "feature int, value double")
    assert [r[0] for r in df.select(ranks.stacked_range(limits, ["a", "b", "c"])).collect()] == [1, 2, 3, 0, 0, 1]
