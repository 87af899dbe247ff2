"""What large data rest on: hot keys, plans, shared folders, and tasks without the package."""

import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cohortry.functions import tails
from cohortry.operators import anova, features, ranks, segments, splits
from cohortry.sources import scratch
from cohortry.sources.tables import SCHEMAS, Tables


@pytest.fixture(scope="module")
def raw():
    """One order, one product, one customer, one score and one payment type each hold a third of the rows or more."""
    rng = np.random.default_rng(9)
    n_orders, n_items = 3000, 24000

    def hot(size, high):
        return np.where(rng.random(size) < 0.35, 0, rng.integers(0, high, size))

    orders = pd.DataFrame({"order_id": [f"o{i}" for i in range(n_orders)], "customer_id": [f"k{i}" for i in range(n_orders)]})
    orders["order_status"] = np.where(rng.random(n_orders) < 0.9, "delivered", "canceled")
    day = pd.Timestamp("2018-01-01")
    orders["order_purchase_timestamp"] = day + pd.to_timedelta(rng.integers(0, 300, n_orders), "h")
    orders["order_delivered_customer_date"] = day + pd.to_timedelta(rng.integers(0, 900, n_orders), "h")
    orders["order_estimated_delivery_date"] = day + pd.Timedelta(days=20)
    customers = pd.DataFrame({"customer_id": orders["customer_id"], "customer_unique_id": [f"u{i}" for i in hot(n_orders, 500)]})
    customers["customer_state"] = [f"s{i}" for i in hot(n_orders, 20)]
    items = pd.DataFrame({"order_id": [f"o{i}" for i in hot(n_items, n_orders)], "order_item_id": 1, "product_id": [f"p{i}" for i in hot(n_items, 200)]})
    items["price"], items["freight_value"] = rng.integers(1, 400, n_items) / 4, rng.integers(1, 40, n_items) / 4
    reviews = pd.DataFrame({"order_id": [f"o{i}" for i in hot(n_orders, n_orders)], "review_score": np.where(rng.random(n_orders) < 0.5, 5, rng.integers(1, 6, n_orders))})
    payments = pd.DataFrame({"order_id": [f"o{i}" for i in hot(n_orders, n_orders)], "payment_type": [f"t{i}" for i in hot(n_orders, 4)]})
    payments["payment_installments"], payments["payment_value"] = rng.integers(1, 10, n_orders), rng.integers(1, 4000, n_orders) / 4
    products = pd.DataFrame({"product_id": [f"p{i}" for i in range(200)], "product_category_name": [f"c{i % 30}" for i in range(200)]})
    translation = pd.DataFrame({"product_category_name": [f"c{i}" for i in range(29)], "product_category_name_english": [f"e{i}" for i in range(29)]})
    return dict(zip(SCHEMAS, (orders, customers, items, reviews, payments, products, translation)))


@pytest.fixture(scope="module")
def tables(spark, raw):
    return Tables(**{n: spark.createDataFrame(df[[c.split()[0] for c in SCHEMAS[n].split(", ")]], SCHEMAS[n]) for n, df in raw.items()})


def usual(values):
    m = values.mode()
    return m[0] if len(m) else "unknown"


def expected_features(raw):
    orders = raw["orders"].merge(raw["customers"], on="customer_id")
    items = raw["order_items"].merge(raw["products"], on="product_id").merge(raw["translation"], on="product_category_name", how="left")
    by_order = items.groupby("order_id").agg(
        price=("price", "sum"), freight=("freight_value", "sum"), n=("price", "count"), top=("product_category_name_english", usual)
    )
    scores = raw["order_reviews"].groupby("order_id")["review_score"].mean().rename("score")
    pay = raw["order_payments"].groupby("order_id").agg(installments=("payment_installments", "mean"), kind=("payment_type", usual))
    o = orders[orders["order_status"] == "delivered"].set_index("order_id").join(by_order).join(scores).join(pay)
    o["delay"] = (o["order_delivered_customer_date"] - o["order_estimated_delivery_date"]).dt.days
    o["ratio"] = o["freight"] / (o["price"] + o["freight"] + 1e-6)
    out = o.groupby("customer_unique_id").agg(
        frequency=("delay", "size"), avg_delay_days=("delay", "mean"), avg_freight_ratio=("ratio", "mean"), avg_review_score=("score", "mean"),
        avg_payment_installments=("installments", "mean"), avg_order_value=("price", "mean"), total_spent=("price", "sum"),
        avg_item_count=("n", "mean"), favorite_category=("top", usual), preferred_payment=("kind", usual),
    )
    out["avg_review_score"] = out["avg_review_score"].fillna(out["avg_review_score"].median())
    return out


def test_features_with_hot_keys(tables, raw):
    got = features.customer_features(tables).toPandas().set_index("customer_unique_id").sort_index()
    want = expected_features(raw).sort_index()
    assert list(got.index) == list(want.index)
    for column in want:
        if want[column].dtype == object:
            assert got[column].tolist() == want[column].tolist(), column
        else:
            np.testing.assert_allclose(got[column].astype(float), want[column].astype(float), rtol=1e-7, atol=2e-9, err_msg=column)


def test_medians_with_a_hot_value(tables, raw):
    fm = segments.fm_metrics(tables)
    orders = raw["orders"][raw["orders"]["order_status"] == "delivered"].merge(raw["customers"], on="customer_id")
    paid = orders.merge(raw["order_payments"], on="order_id").groupby("customer_unique_id").agg(f=("order_id", "nunique"), m=("payment_value", "sum"))
    assert segments.fm_medians(fm) == (paid["f"].median(), pytest.approx(paid["m"].median()))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_values_are_counted_once_for_both_uses(spark, tmp_path):
    spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).cast("double").alias("v")).write.parquet(str(tmp_path / "t"))
    plan = final_plan(ranks.value_positions(spark.read.parquet(str(tmp_path / "t")), ["g"], "v"))
    assert "ReusedExchange" in plan and "CartesianProduct" not in plan and "SinglePartition" not in plan


def test_feature_plan(tables):
    plan = features.customer_rollup(features.order_features(tables))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan and "SinglePartition" not in plan
    assert "ObjectHashAggregate" not in plan  # no table of values inside an aggregate


def test_levels_are_broadcast_when_few_and_joined_by_shuffle_else(spark):
    df = spark.range(50).select((F.col("id") % 10).alias("g"), F.col("id").cast("double").alias("v"))
    rows = anova.levene(df, "g", "v").collect()
    medians = ranks.exact_quantiles(df, ["g"], "v", {"m": 0.5})
    assert "BroadcastHashJoin" in ranks.beside(df, medians, ["g"])._jdf.queryExecution().executedPlan().toString()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as if the levels were many
        assert "SortMergeJoin" in ranks.beside(df, medians, ["g"])._jdf.queryExecution().executedPlan().toString()
        assert anova.levene(df, "g", "v").collect() == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


class Named:
    """A session whose configuration names (or does not name) a shared folder."""

    def __init__(self, spark, folder, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": spark.sparkContext.applicationId})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: folder if key == "spark.checkpoint.dir" else default)})


def test_shared_folder_is_the_one_the_session_names(spark):
    assert scratch.shared_folder(Named(spark, "hdfs://shared/x", "yarn")) == "hdfs://shared/x"
    assert scratch.shared_folder(Named(spark, "hdfs://shared/x", "local[2]")) == "hdfs://shared/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):  # never a local folder on a cluster
        scratch.shared_folder(Named(spark, None, "yarn"))
    own = scratch.shared_folder(Named(spark, None, "local[2]"))
    assert os.path.isdir(own) and scratch.shared_folder(Named(spark, None, "local[2]")) == own


def test_kept_tables_are_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: str(tmp_path))
    kept = scratch.keep(spark.range(10))
    assert kept.count() == 10 and len(list(tmp_path.iterdir())) == 1
    assert all(str(tmp_path) in f for f in kept.inputFiles())


def test_task_functions_need_no_package(tmp_path):
    functions = [tails.f_tail, tails._rowwise, tails.studentized_range_critical, anova._two_way_table]
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(functions))
    code = "import pickle; f = pickle.load(open('f.pkl', 'rb')); print(round(f[0](3.0, 2, 2), 9), round(f[2](3, 10), 2))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert out.stdout.split() == ["0.25", "3.88"], out.stderr


def test_splits_do_not_depend_on_the_shuffle_width(spark):
    df = spark.range(997).select(F.col("id").alias("k"), (F.col("id") % 9 == 0).cast("int").alias("y"))
    results, width = [], spark.conf.get("spark.sql.shuffle.partitions")
    for w in ("2", "13", width):
        spark.conf.set("spark.sql.shuffle.partitions", w)
        held = sorted(r["k"] for r in splits.holdout(df, "k", "y").filter("is_test = 1").collect())
        folds = sorted((r["k"], r["fold"]) for r in splits.stratified_folds(df, "y", "k").collect())
        results.append((held, folds))
    assert results[0] == results[1] == results[2]
