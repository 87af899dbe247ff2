"""Semantics of the customer features on hand-written tables."""

from datetime import datetime

import pytest

from cohortry.functions.columns import whole_days
from cohortry.operators import features as fx
from cohortry.sources.tables import SCHEMAS, Tables, load
from pyspark.sql import functions as F


def table(spark, name, rows):
    return spark.createDataFrame(rows, SCHEMAS[name])


def d(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def tables(spark):
    est = d("2018-01-10 00:00:00")
    return Tables(
        orders=table(
            spark, "orders",
            [
                ("o1", "k1", "delivered", d("2018-01-01"), d("2018-01-09 23:00:00"), est),  # one hour early
                ("o2", "k2", "delivered", d("2018-01-02"), d("2018-01-12 05:00:00"), est),  # two days late
                ("o3", "k3", "delivered", d("2018-01-03"), None, est),  # nothing but the order
                ("o4", "k4", "shipped", d("2018-01-04"), d("2018-01-05"), est),
                ("o5", "k5", "delivered", d("2018-01-05"), d("2018-01-10"), est),  # customer without person
                ("o6", "k6", "delivered", d("2018-01-06"), d("2018-01-10"), est),
            ],
        ),
        customers=table(
            spark, "customers",
            [
                ("k1", "ann", None),  # state unknown on the first order
                ("k2", "ann", "SP"),
                ("k3", "bob", "RJ"),
                ("k4", "ann", "MG"),
                ("k5", None, "SP"),
                ("k6", "cat", "BA"),
            ],
        ),
        order_items=table(
            spark, "order_items",
            [
                ("o1", 1, "p1", 10.0, 2.0),
                ("o1", 2, "p2", 20.0, 3.0),  # category tie with p1
                ("o2", 1, "p3", 30.0, 5.0),  # product without translation
                ("o4", 1, "p1", 99.0, 9.0),
                ("o6", 1, "p9", 40.0, 0.0),  # unknown product
            ],
        ),
        order_reviews=table(spark, "order_reviews", [("o1", 5), ("o1", 2), ("o2", None), ("o6", 1)]),
        order_payments=table(
            spark, "order_payments",
            [
                ("o1", "voucher", 1, 5.0),
                ("o1", "boleto", 3, 30.0),  # tie: boleto is smaller
                ("o2", "voucher", 2, 35.0),
                ("o6", "credit_card", None, 40.0),
            ],
        ),
        products=table(spark, "products", [("p1", "moveis"), ("p2", "arte"), ("p3", "sem_nome"), ("p4", None)]),
        translation=table(spark, "translation", [("moveis", "furniture"), ("arte", "art")]),
    )


@pytest.fixture(scope="module")
def people(tables):
    return {r["customer_unique_id"]: r for r in fx.customer_features(tables).collect()}


def test_only_persons_with_delivered_orders(people):
    assert sorted(people) == ["ann", "bob", "cat"]
    assert people["ann"]["frequency"] == 2 and people["ann"]["is_repeat"] == 1
    assert people["bob"]["is_repeat"] == 0


def test_days_round_down(people):
    assert people["ann"]["avg_delay_days"] == 0.5  # -1 and 2


def test_missing_delay_is_zero_and_missing_score_the_median(people):
    assert people["bob"]["avg_delay_days"] == 0.0
    assert people["ann"]["avg_review_score"] == 3.5  # a null score does not count
    assert people["bob"]["avg_review_score"] == 2.25  # median of 3.5 and 1.0


def test_money(people):
    assert people["ann"]["avg_order_value"] == 30.0 and people["ann"]["total_spent"] == 60.0
    assert people["bob"]["avg_order_value"] is None and people["bob"]["total_spent"] == 0.0
    assert people["ann"]["avg_freight_ratio"] == pytest.approx((5 / 35 + 5 / 35) / 2, abs=1e-7)


def test_modes(people):
    # order 1 ties art and furniture -> art; order 2 has no English name -> unknown; art < unknown
    assert people["ann"]["favorite_category"] == "art"
    assert people["bob"]["favorite_category"] == "unknown"  # no items at all
    assert people["cat"]["favorite_category"] == "unknown"  # unknown product
    # order 1 ties boleto and voucher -> boleto; then boleto and voucher tie
    assert people["ann"]["preferred_payment"] == "boleto"
    assert people["bob"]["preferred_payment"] == "unknown"
    assert people["cat"]["avg_payment_installments"] is None


def test_first_known_state(people):
    assert people["ann"]["state"] == "SP"


def test_summaries(tables):
    items = {r["order_id"]: r for r in fx.order_summary(tables.order_items).collect()}
    assert items["o1"].asDict() == {"order_id": "o1", "total_price": 30.0, "total_freight": 5.0, "item_count": 2}
    pays = {r["order_id"]: r for r in fx.order_payment(tables.order_payments).collect()}
    assert (pays["o1"]["payment_installments"], pays["o1"]["payment_value"]) == (2.0, 35.0)
    top = {r["order_id"]: r["top_category"] for r in fx.order_top_category(tables).collect()}
    assert top == {"o1": "art", "o2": "unknown", "o4": "furniture", "o6": "unknown"}


def test_whole_days_against_floor(spark):
    rows = [(d("2020-03-01 12:00:00"), d(t)) for t in (
        "2020-03-01 12:00:00", "2020-03-01 11:59:59", "2020-03-02 11:59:59", "2020-03-02 12:00:00",
        "2020-02-28 12:00:01", "2019-03-01 12:00:00", "2020-03-29 02:30:00")]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(whole_days(F.col("a"), F.col("b"))).collect()]
    assert got == [(b - a).days for a, b in rows]


def test_csv_scan(spark, tmp_path):
    """Byte-order mark, extra columns in another order, quoted line breaks, doubled quotes, broken dates."""
    files = {
        "orders": "order_status,order_id,customer_id,order_purchase_timestamp,extra,order_delivered_customer_date,"
        "order_estimated_delivery_date\ndelivered,o1,k1,2018-01-01 10:00:00,x,not a date,2018-01-10 00:00:00\n",
        "customers": "customer_id,customer_unique_id,customer_state\nk1,ann,SP\n",
        "order_items": "order_id,order_item_id,product_id,price,freight_value\no1,1,p1,10.5,1.5\n",
        "order_reviews": 'review_id,order_id,review_score,message\nr1,o1,4,"two\nlines, and ""quotes"""\nr2,o1,2,\n',
        "order_payments": "order_id,payment_type,payment_installments,payment_value\no1,boleto,1,12\n",
        "products": "product_id,product_category_name\np1,moveis\n",
        "translation": "﻿product_category_name,product_category_name_english\nmoveis,furniture",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    t = load(spark, {name: str(tmp_path / f"{name}.csv") for name in files})
    row = fx.customer_features(t).first()
    assert row["favorite_category"] == "furniture" and row["avg_review_score"] == 3.0
    assert row["avg_delay_days"] == 0.0 and row["avg_order_value"] == 10.5
    order = t.orders.first()
    assert order["order_delivered_customer_date"] is None and order["order_purchase_timestamp"] == d("2018-01-01 10:00:00")


def test_parquet_and_catalog_scans(spark, tables, tmp_path):
    for name, df in tables.named().items():
        df.write.parquet(str(tmp_path / name))
        df.createOrReplaceTempView(f"scan_{name}")
    expected = sorted(map(str, fx.customer_features(tables).collect()))
    from_files = load(spark, {n: str(tmp_path / n) for n in SCHEMAS}, "parquet")
    from_views = load(spark, {n: f"scan_{n}" for n in SCHEMAS}, "table")
    assert sorted(map(str, fx.customer_features(from_files).collect())) == expected
    assert sorted(map(str, fx.customer_features(from_views).collect())) == expected


def test_rows_of_other_orders_are_held_back(spark, tables):
    orders = spark.range(0, 40_000, 40).select(F.col("id").alias("order_id"))
    rows = spark.range(40_000).select(F.when(F.col("id") < 39_990, F.col("id")).alias("order_id"), F.lit("x").alias("note"))
    kept = fx.held_back(rows, "order_id", orders.union(orders).union(spark.sql("SELECT CAST(NULL AS BIGINT)")))
    assert kept.columns == rows.columns and kept.filter("order_id % 40 = 0").count() == 1000
    assert kept.count() < 1500 and kept.filter("order_id IS NULL").isEmpty()
    assert "Exchange hashpartitioning(order_id" not in kept._jdf.queryExecution().executedPlan().toString()
    assert fx.held_back(rows.withColumn("order_id", F.col("order_id").cast("int")), "order_id", orders).count() == 40_000
    own = fx.of_orders(tables, fx.delivered(tables.orders))
    assert {r["order_id"] for r in own.order_items.collect()} == {"o1", "o2", "o6"}  # o4 is shipped, not delivered
    plan = fx.order_features(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("bit_or") >= 1


def test_features_are_rolled_up_once(spark, tables, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = tables.orders.coalesce(1).mapInArrow(counted, tables.orders.schema)
    once = fx.replace(tables, orders=rows)
    fx.order_features(once).collect()
    scans, start = seen.value, seen.value
    fx.customer_features(once).collect()
    assert seen.value - start == scans  # the median and the result read the kept rollup
