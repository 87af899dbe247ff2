"""Segments, recommendations, reports and sinks on hand-written tables."""

from datetime import datetime

import pytest

from cohortry.operators import segments as seg
from cohortry.operators import summaries
from cohortry.sources.sinks import write_results
from cohortry.sources.tables import SCHEMAS, Tables

DAY = datetime(2018, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    def make(name, rows):
        return spark.createDataFrame(rows, SCHEMAS[name])

    orders = [(f"o{i}", f"k{i}", "delivered" if i < 9 else "canceled", DAY, DAY, DAY) for i in range(12)]
    people = ["ann", "ann", "ann", "bob", "bob", "cat", "dan", "dan", "dan", "eve", "ann", None]
    return Tables(
        orders=make("orders", orders),
        customers=make("customers", [(f"k{i}", p, "SP") for i, p in enumerate(people)]),
        order_items=make("order_items", [(f"o{i}", n, f"p{(i + n) % 4}", 10.0, 1.0) for i in range(12) for n in range(1 + i % 3)]),
        order_reviews=make("order_reviews", [(f"o{i}", 1 + i % 5) for i in range(11)] + [("o2", 5), ("o4", None)]),
        order_payments=make(
            "order_payments", [(f"o{i}", "boleto", 1, 10.0 * (i + 1)) for i in range(12) if i != 8] + [("o0", "voucher", 1, 500.0)]
        ),
        products=make("products", [("p0", "a"), ("p1", "b"), ("p2", "a"), ("p3", "none")]),
        translation=make("translation", [("a", "alpha"), ("b", "beta"), ("c", "")]),
    )


def test_fm_metrics_count_orders_once(tables):
    got = {r["customer_unique_id"]: (r["frequency"], r["monetary"]) for r in seg.fm_metrics(tables).collect()}
    # o0 has two payments and counts once; o8 has none and does not count
    assert got == {"ann": (3, 560.0), "bob": (2, 90.0), "cat": (1, 60.0), "dan": (2, 150.0)}


def test_segments_use_exact_medians_and_first_match(tables):
    fm = seg.fm_metrics(tables)
    assert seg.fm_medians(fm) == (2.0, 120.0)
    got = {r["customer_unique_id"]: r["segment"] for r in seg.fm_segments(fm).collect()}
    assert got == {"ann": seg.HIGH_VALUE, "bob": seg.HIGH_FREQUENCY, "cat": seg.ORDINARY, "dan": seg.HIGH_VALUE}


def test_segment_frequencies(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",), ("z",)], "segment string")
    rows = [(r["segment"], r["frequency"], r["percent"], r["cum_frequency"], r["cum_percent"]) for r in seg.segment_frequencies(df).collect()]
    assert rows == [("x", 2, 50.0, 2, 50.0), ("y", 1, 25.0, 3, 75.0), ("z", 1, 25.0, 4, 100.0)]


def brute_ratings(tables, categories, min_rating, min_sales):
    """The fan-out join written out."""
    names = {"p0": "alpha", "p1": "beta", "p2": "alpha"}
    reviews = {}
    for r in tables.order_reviews.collect():
        reviews.setdefault(r["order_id"], []).append(r["review_score"])
    groups = {}
    for item in tables.order_items.collect():
        category = names.get(item["product_id"])
        if category in categories:
            orders, scores = groups.setdefault((category, item["product_id"]), (set(), []))
            orders.add(item["order_id"])
            scores += [s for s in reviews.get(item["order_id"], []) if s is not None]
    return {
        k: (len(o), pytest.approx(sum(s) / len(s))) for k, (o, s) in groups.items() if s and sum(s) / len(s) >= min_rating and len(o) >= min_sales
    }


def test_ratings_weigh_reviews_by_items(tables):
    popular = seg.popular_categories(tables, seg.fm_segments(seg.fm_metrics(tables)))
    counts = {r["category"]: r["buy_count"] for r in popular.collect()}
    assert set(counts) == {"alpha", "beta"}
    got = seg.product_ratings(tables, seg.leading_categories(popular), 2.0, 2).collect()
    assert {(r["category"], r["product_id"]): (r["sales"], r["avg_rating"]) for r in got} == brute_ratings(tables, set(counts), 2.0, 2)
    top = seg.recommendations(tables, popular, 2.0, 2).collect()
    for category in counts:
        ranked = sorted((r["rank"], -r["avg_rating"]) for r in top if r["category"] == category)
        assert [r for r, _ in ranked] == list(range(1, len(ranked) + 1)) and [s for _, s in ranked] == sorted(s for _, s in ranked)


def test_report_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([("x", 1, 2.5), ("y", 2, None)], "name string, n int, v double")
    b = spark.createDataFrame([(7,)], "total long")
    rows = {(r["section"], r["row"], r["metric"]): r["value"] for r in summaries.report({"a": a, "b": b}).collect()}
    assert rows == {("a", "x", "n"): 1.0, ("a", "x", "v"): 2.5, ("a", "y", "n"): 2.0, ("a", "y", "v"): None, ("b", "", "total"): 7.0}
    for fmt in ("parquet", "csv"):
        paths = write_results({"a": a, "b": b}, str(tmp_path / fmt), fmt)
        back = spark.read.schema(a.schema).option("header", True).format(fmt).load(paths["a"])
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, a.collect()), key=str)
