"""Frequency x monetary segments of customers and product recommendations for the best of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.functions.columns import on_grid
from cohortry.operators.features import delivered, named_products
from cohortry.operators.ranks import exact_quantiles
from cohortry.sources.tables import Tables

# The four segment labels, from both high, frequency only, money only, neither; and the report sizes
# and recommendation limits.
HIGH_VALUE = "高價值客戶"
HIGH_FREQUENCY = "高頻客戶"
HIGH_MONETARY = "高額客戶"
ORDINARY = "一般客戶"
TOP_TARGETS = 20
TOP_CATEGORIES = 10
RECOMMEND_CATEGORIES = 3
RECOMMEND_PER_CATEGORY = 5
MIN_RATING = 4.0
MIN_SALES = 5


def fm_metrics(t: Tables) -> DataFrame:
    """Per customer: delivered orders that have a payment, and the money paid for them.

    Payments are folded to one row per order first. Order ids are unique, so counting those rows counts distinct
    orders, without fanning orders out to payments and without a distinct aggregation.
    """
    paid = t.order_payments.groupBy("order_id").agg(F.sum("payment_value").alias("paid"))
    return (
        delivered(t.orders)
        .select("order_id", "customer_id")
        .join(t.customers.filter(F.col("customer_unique_id").isNotNull()), "customer_id")
        .join(paid, "order_id")
        .groupBy("customer_unique_id")
        .agg(F.count("order_id").alias("frequency"), on_grid(F.sum("paid")).alias("monetary"))
    )


def fm_medians(fm: DataFrame) -> tuple[float | None, float | None]:
    """The exact median frequency and median spending: two numbers."""
    found = []
    for column in ("frequency", "monetary"):
        row = exact_quantiles(fm, [], column, {"median": 0.5}).first()
        found.append(None if row is None else row["median"])
    return found[0], found[1]


def fm_segments(fm: DataFrame, medians: tuple[float | None, float | None] | None = None) -> DataFrame:
    """Label each customer by whether it reaches the median frequency and the median spending."""
    typical_frequency, typical_monetary = medians or fm_medians(fm)
    often = F.col("frequency") >= F.lit(typical_frequency)
    much = F.col("monetary") >= F.lit(typical_monetary)
    return fm.withColumn(
        "segment",
        F.when(often & much, HIGH_VALUE).when(often, HIGH_FREQUENCY).when(much, HIGH_MONETARY).otherwise(ORDINARY),
    )


def segment_frequencies(segmented: DataFrame) -> DataFrame:
    """One-way frequency table in label order: count, percent and their running sums.

    The windows run over the segment counts, four rows at most.
    """
    everyone = Window.partitionBy()
    so_far = Window.partitionBy().orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    return (
        segmented.groupBy("segment")
        .agg(F.count(F.lit(1)).alias("frequency"))
        .select(
            "segment",
            "frequency",
            (F.col("frequency") * 100 / F.sum("frequency").over(everyone)).alias("percent"),
            F.sum("frequency").over(so_far).alias("cum_frequency"),
            (F.sum("frequency").over(so_far) * 100 / F.sum("frequency").over(everyone)).alias("cum_percent"),
        )
        .orderBy("segment")
    )


def target_customers(segmented: DataFrame, label: str = HIGH_VALUE) -> DataFrame:
    return segmented.filter(F.col("segment") == label)


def top_targets(segmented: DataFrame, rows: int = TOP_TARGETS) -> DataFrame:
    """The first target customers in id order."""
    return target_customers(segmented).orderBy("customer_unique_id").limit(rows)


def popular_categories(t: Tables, segmented: DataFrame) -> DataFrame:
    """Items bought by target customers in delivered orders, counted by English category."""
    target_orders = (
        delivered(t.orders)
        .select("order_id", "customer_id")
        .join(t.customers.select("customer_id", "customer_unique_id"), "customer_id")
        .join(target_customers(segmented).select("customer_unique_id"), "customer_unique_id", "left_semi")
        .select("order_id")
    )
    named = named_products(t).filter(F.col("product_category_name_english") != "")
    return (
        t.order_items.select("order_id", "product_id")
        .join(target_orders, "order_id")
        .join(named, "product_id")
        .groupBy(F.col("product_category_name_english").alias("category"))
        .agg(F.count(F.lit(1)).alias("buy_count"))
    )


def leading_categories(popular: DataFrame, rows: int = TOP_CATEGORIES) -> DataFrame:
    return popular.orderBy(F.desc("buy_count"), "category").limit(rows)


def product_ratings(
    t: Tables,
    categories: DataFrame,
    min_rating: float = MIN_RATING,
    min_sales: int = MIN_SALES,
    delivered_only: bool = False,
) -> DataFrame:
    """Sales and mean rating of the products of some categories, above a rating and a sales limit.

    The mean weighs every review by the item lines of its order, as a join of items to reviews would. Both sides are
    folded to one row per order before they meet, so nothing fans out and no distinct count is needed. ``categories``
    is a top-k table, so it is small enough to broadcast. Lines are counted before products are joined: no step after the
    join needs a product's orders together until they are folded again, so adaptive execution can split a product that
    holds much of the items. All orders count unless ``delivered_only``.
    """
    chosen = t.translation.withColumnRenamed("product_category_name_english", "category").join(
        F.broadcast(categories.select("category")), "category", "left_semi"
    )
    lines = (
        t.order_items.groupBy("product_id", "order_id")
        .agg(F.count(F.lit(1)).alias("lines"))
        .join(t.products.join(chosen, "product_category_name").select("product_id", "category"), "product_id")
    )
    if delivered_only:
        lines = lines.join(delivered(t.orders).select("order_id"), "order_id", "left_semi")
    scores = t.order_reviews.groupBy("order_id").agg(
        F.sum("review_score").alias("score_sum"), F.count("review_score").alias("score_n")
    )
    return (
        lines.join(scores, "order_id", "left")
        .groupBy("category", "product_id")
        .agg(
            F.count("order_id").alias("sales"),
            (F.sum(F.col("lines") * F.col("score_sum")) / F.sum(F.col("lines") * F.col("score_n"))).alias(
                "avg_rating"
            ),
        )
        .filter((F.col("avg_rating") >= min_rating) & (F.col("sales") >= min_sales))
    )


def recommendations(
    t: Tables,
    popular: DataFrame,
    min_rating: float = MIN_RATING,
    min_sales: int = MIN_SALES,
    delivered_only: bool = False,
) -> DataFrame:
    """The best rated products of the three most popular categories, five at most from each."""
    rated = product_ratings(
        t, leading_categories(popular, RECOMMEND_CATEGORIES), min_rating, min_sales, delivered_only
    )
    best_first = Window.partitionBy("category").orderBy(F.desc("avg_rating"), F.desc("sales"), "product_id")
    return rated.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= RECOMMEND_PER_CATEGORY)
