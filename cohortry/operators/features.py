"""Order summaries and the one-row-per-customer feature table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.columns import UNKNOWN, most_counted, on_grid, whole_days
from cohortry.operators.ranks import exact_quantiles
from cohortry.sources.scratch import keep
from cohortry.sources.tables import Tables

DELIVERED = "delivered"

FEATURE_COLUMNS = [
    "customer_unique_id",
    "frequency",
    "avg_delay_days",
    "avg_freight_ratio",
    "avg_review_score",
    "avg_payment_installments",
    "avg_order_value",
    "total_spent",
    "avg_item_count",
    "favorite_category",
    "state",
    "preferred_payment",
    "is_repeat",
]


def _usual(value: str, rows: str, name: str) -> Column:
    return F.coalesce(most_counted(value, rows), F.lit(UNKNOWN)).alias(name)


def _mean(of: str) -> Column:
    """Mean of what was folded to a sum and a count before."""
    return F.try_divide(F.sum(f"_{of}_sum"), F.sum(f"_{of}_n"))


def _folded(*names: str) -> list[Column]:
    return [c for n in names for c in (F.sum(n).alias(f"_{n}_sum"), F.count(n).alias(f"_{n}_n"))]


def delivered(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("order_status") == DELIVERED)


MASK_BITS = 1 << 27  # 64 a row, so at most 2 million rows are broadcast, however many keys there are


def held_back(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows without most of those whose key is not wanted, nothing shuffled; rows of a wanted key all stay, a null key is never wanted.

    Each wanted key marks a bit, and the words that hold a mark are broadcast. A row stays if the bit of its key is marked, so some
    with another key stay too, more of them the more keys are wanted: a join by key must follow. Rows keep their partitioning. Keys of
    two types, which a join may still match, have other bits: then all rows stay.
    """
    if rows.schema[key].dataType != wanted.schema[key].dataType:
        return rows
    bit = F.pmod(F.xxhash64(key), F.lit(MASK_BITS))
    marks = wanted.select(key).filter(F.col(key).isNotNull()).distinct().select(F.shiftright(bit, 6).alias("_word"), bit.alias("_bit"))
    words = marks.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_marks"))
    placed = rows.filter(F.col(key).isNotNull()).withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6))
    marked = placed.join(F.broadcast(words), "_word").filter(F.expr("shiftright(_marks, cast(_bit & 63 as int)) & 1L") == 1)
    return marked.select(*rows.columns)


def of_orders(t: Tables, orders: DataFrame) -> Tables:
    """The bundle with few items, reviews and payments of other orders, so that folds by order shuffle about what the orders need."""
    names = ("order_items", "order_reviews", "order_payments")
    return replace(t, **{n: held_back(getattr(t, n), "order_id", orders) for n in names})


def order_summary(items: DataFrame) -> DataFrame:
    """Per order: price sum, freight sum and number of items."""
    return items.groupBy("order_id").agg(
        F.sum("price").alias("total_price"), F.sum("freight_value").alias("total_freight"), F.count("order_item_id").alias("item_count")
    )


def order_review(reviews: DataFrame) -> DataFrame:
    """Per order: mean review score."""
    return reviews.groupBy("order_id").agg(F.avg("review_score").alias("review_score"))


def order_payment(payments: DataFrame) -> DataFrame:
    """Per order: mean instalments, value paid and the usual payment type.

    Rows are counted by order and type first, so a mode is the largest of few counts and no aggregate holds a table of values.
    """
    by_type = payments.groupBy("order_id", "payment_type").agg(
        *_folded("payment_installments"), F.sum("payment_value").alias("payment_value"), F.count(F.lit(1)).alias("_rows")
    )
    return by_type.groupBy("order_id").agg(
        _mean("payment_installments").alias("payment_installments"),
        F.sum("payment_value").alias("payment_value"),
        _usual("payment_type", "_rows", "payment_type"),
    )


def named_products(t: Tables) -> DataFrame:
    """Products with their English category name. Names are joined to the products, not to the far more numerous items,
    so no item row is ever shuffled by category."""
    return t.products.join(t.translation, "product_category_name", "left").select(
        "product_id", "product_category_name_english"
    )


def items_with_category(t: Tables) -> DataFrame:
    """Items with their English category name, null where the product or its translation is missing.

    No side is hinted: products are broadcast when their size allows it; otherwise the join shuffles by product, and
    adaptive execution splits the partitions of hot products.
    """
    return t.order_items.join(named_products(t), "product_id", "left")


def order_items_folded(t: Tables) -> DataFrame:
    """Per order: the item sums and the category most of its items belong to.

    Product and category are unique keys, so both come from one fold of the items by order and category.
    """
    by_category = items_with_category(t).groupBy("order_id", "product_category_name_english").agg(
        F.sum("price").alias("total_price"),
        F.sum("freight_value").alias("total_freight"),
        F.count("order_item_id").alias("item_count"),
        F.count(F.lit(1)).alias("_rows"),
    )
    return by_category.groupBy("order_id").agg(
        F.sum("total_price").alias("total_price"),
        F.sum("total_freight").alias("total_freight"),
        F.sum("item_count").alias("item_count"),
        _usual("product_category_name_english", "_rows", "top_category"),
    )


def order_top_category(t: Tables) -> DataFrame:
    """Per order: the category most of its items belong to."""
    return order_items_folded(t).select("order_id", "top_category")


def order_features(t: Tables) -> DataFrame:
    """One row per delivered order with its customer, timings, money, score and payment.

    Rows of other orders are held back before anything is folded. All joins by order come first, so tables stored by order are
    joined where they lie.
    """
    customers = t.customers.filter(F.col("customer_unique_id").isNotNull())
    orders = delivered(t.orders)
    own = of_orders(t, orders)
    return (
        orders.join(order_items_folded(own), "order_id", "left")
        .join(order_review(own.order_reviews), "order_id", "left")
        .join(order_payment(own.order_payments).drop("payment_value"), "order_id", "left")
        .join(customers, "customer_id", "left")
        .withColumn(
            "delay_days",
            whole_days(F.col("order_estimated_delivery_date"), F.col("order_delivered_customer_date")),
        )
        .withColumn(
            "freight_ratio",
            F.col("total_freight") / (F.col("total_price") + F.col("total_freight") + F.lit(1e-6)),
        )
    )


AVERAGED = ["delay_days", "freight_ratio", "review_score", "payment_installments", "total_price", "item_count"]
CATEGORY, PAYMENT = 0, 1


def customer_rollup(orders: DataFrame) -> DataFrame:
    """Fold order features into customers, in two steps that both combine before their shuffle.

    Each order stands twice, once with its category and once with its payment type, and is counted by customer and value; the sums
    ride on the first. The second step adds the sums up and picks the value with the largest count, so neither step holds more
    than a few numbers a group, and a customer holding a large part of all orders costs no more than any other.
    """
    known = orders.filter(F.col("customer_unique_id").isNotNull())
    first_state = F.when(F.col("customer_state").isNotNull(), F.struct("order_purchase_timestamp", "order_id", "customer_state"))
    carried = {**{c: F.col(c) for c in AVERAGED}, "order_id": F.col("order_id"), "state": first_state}

    def entry(kind: int, value: str) -> Column:
        own = [(c if kind == CATEGORY else F.lit(None).cast(t)).alias(n) for (n, c), t in zip(carried.items(), kinds)]
        return F.struct(F.lit(kind).alias("_kind"), F.col(value).alias("_value"), *own)

    kinds = [f.dataType for f in known.select(*[c.alias(n) for n, c in carried.items()]).schema.fields]
    stacked = known.select("customer_unique_id", F.inline(F.array(entry(CATEGORY, "top_category"), entry(PAYMENT, "payment_type"))))
    counted = stacked.groupBy("customer_unique_id", "_kind", "_value").agg(
        *_folded(*AVERAGED), F.count("order_id").alias("frequency"), F.min("state").alias("state"), F.count(F.lit(1)).alias("_rows")
    )

    def usual(kind: int, name: str) -> Column:
        return F.coalesce(most_counted(F.when(F.col("_kind") == kind, F.col("_value")), "_rows"), F.lit(UNKNOWN)).alias(name)

    rolled = counted.groupBy("customer_unique_id").agg(
        F.sum("frequency").alias("frequency"),
        on_grid(_mean("delay_days")).alias("avg_delay_days"),
        on_grid(_mean("freight_ratio")).alias("avg_freight_ratio"),
        on_grid(_mean("review_score")).alias("avg_review_score"),
        on_grid(_mean("payment_installments")).alias("avg_payment_installments"),
        on_grid(_mean("total_price")).alias("avg_order_value"),
        on_grid(F.coalesce(F.sum("_total_price_sum"), F.lit(0.0))).alias("total_spent"),
        on_grid(_mean("item_count")).alias("avg_item_count"),
        usual(CATEGORY, "favorite_category"),
        F.min("state")["customer_state"].alias("state"),
        usual(PAYMENT, "preferred_payment"),
    )
    return rolled.withColumn("is_repeat", (F.col("frequency") > 1).cast("int"))


def fill_gaps(rolled: DataFrame, typical_score: float | None) -> DataFrame:
    """Replace a missing delay by 0 and a missing score by the median score of all customers."""
    fills = {"avg_delay_days": 0.0}
    if typical_score is not None:
        fills["avg_review_score"] = typical_score
    return rolled.fillna(fills).select(*FEATURE_COLUMNS)


def median_score(rolled: DataFrame) -> float | None:
    """The exact median of the customers' mean scores, one number."""
    row = exact_quantiles(rolled, [], "avg_review_score", {"median": 0.5}).first()
    return None if row is None else row["median"]


def customer_features(t: Tables) -> DataFrame:
    """The 13-column feature table. The rollup is kept, since the median score and the result both read it. Use
    :class:`cohortry.plans.workspace.Workspace` when several analyses share the table."""
    rolled = keep(customer_rollup(order_features(t)))
    return fill_gaps(rolled, median_score(rolled))
