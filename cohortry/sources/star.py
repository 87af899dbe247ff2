"""The seven base tables as views over a TPC-H style star schema stored as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.sources.tables import Tables

# Fixed values of the mapping.
STATUS = {"F": "delivered", "O": "shipped", "P": "canceled"}
PAYMENT_TYPES = ["credit_card", "boleto", "voucher", "debit_card"]
PROMISED_DAYS = 36
UNTRANSLATED_BRAND = "Brand#25"


def star_tables(spark: SparkSession, base: str) -> Tables:
    def scan(name: str) -> DataFrame:
        return spark.read.parquet(f"{base}/{name}.parquet")

    lines = scan("lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))

    customers = (
        scan("customer")
        .join(scan("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("n_name").alias("customer_state"),
        )
    )
    last_ship = lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.max("l_shipdate").alias("order_delivered_customer_date")
    )
    # nested conditions, so that a filter on the name becomes a filter on the code at the scan
    status = F.lit(None)
    for code, name in reversed(STATUS.items()):
        status = F.when(F.col("o_orderstatus") == code, name).otherwise(status)
    orders = (
        scan("orders")
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            status.alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            (F.col("o_orderdate") + F.make_dt_interval(F.lit(PROMISED_DAYS))).alias("order_estimated_delivery_date"),
        )
        .join(last_ship, "order_id", "left")
    )
    return Tables(
        orders=orders,
        customers=customers,
        order_items=lines.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            net.alias("price"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
        ),
        order_reviews=lines.filter(F.col("l_returnflag") == "R").select(
            F.col("l_orderkey").alias("order_id"),
            (F.col("l_quantity").cast("int") % 5 + 1).alias("review_score"),
        ),
        order_payments=lines.filter(F.col("l_returnflag").isin("A", "N")).select(
            F.col("l_orderkey").alias("order_id"),
            F.element_at(
                F.array(*[F.lit(p) for p in PAYMENT_TYPES]), (F.col("l_suppkey") % len(PAYMENT_TYPES) + 1).cast("int")
            ).alias("payment_type"),
            F.col("l_linenumber").alias("payment_installments"),
            (net * (1 + F.col("l_tax"))).alias("payment_value"),
        ),
        products=scan("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("product_category_name")
        ),
        translation=scan("part")
        .filter(F.col("p_brand") != UNTRANSLATED_BRAND)
        .select(F.col("p_brand").alias("product_category_name"))
        .distinct()
        .withColumn(
            "product_category_name_english", F.lower(F.translate("product_category_name", "#", "_"))
        ),
    )
