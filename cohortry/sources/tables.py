"""The seven base tables: declared schemas, readers and the bundle handed to the operators.

Keys, as declared by the data model: ``orders.order_id``, ``customers.customer_id``, ``products.product_id`` and
``translation.product_category_name`` are unique. Items, reviews and payments hold many rows per order.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns the analyses touch, with their types. Timestamps carry no zone: day differences must not move with the
# session's time zone.
SCHEMAS: dict[str, str] = {
    "orders": (
        "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
        "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz"
    ),
    "customers": "customer_id string, customer_unique_id string, customer_state string",
    "order_items": "order_id string, order_item_id int, product_id string, price double, freight_value double",
    "order_reviews": "order_id string, review_score int",
    "order_payments": "order_id string, payment_type string, payment_installments int, payment_value double",
    "products": "product_id string, product_category_name string",
    "translation": "product_category_name string, product_category_name_english string",
}


@dataclass(frozen=True)
class Tables:
    """The seven logical tables every operator starts from."""

    orders: DataFrame
    customers: DataFrame
    order_items: DataFrame
    order_reviews: DataFrame
    order_payments: DataFrame
    products: DataFrame
    translation: DataFrame

    def named(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def declared(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


# Reviews carry free text with line breaks inside quotes. Only they are read as multi-line CSV, which Spark cannot split
# inside a file, so a large review table should come as many files or as parquet.
FREE_TEXT = {"order_reviews"}


def read_csv(spark: SparkSession, path: str, name: str, multi_line: bool | None = None) -> DataFrame:
    """Scan one CSV with a header row.

    ``multi_line`` says whether values hold line breaks; such files are not split, so a large one is one task. By default
    only reviews are read so. Files whose texts have no line breaks are read in parallel with ``False``.

    Columns are matched by header name, so files may hold more columns than are declared and in any order. Values
    that do not parse become null, as the analyses expect of broken dates. A byte-order mark is dropped by the scan.
    """
    raw = spark.read.options(header=True, quote='"', escape='"', multiLine=name in FREE_TEXT if multi_line is None else multi_line).csv(path)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in declared(name)])


def read_parquet(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Scan one parquet data set, keeping only the declared columns."""
    return spark.read.parquet(path).select(*[f.name for f in declared(name)])


def read_catalog(spark: SparkSession, table: str, name: str) -> DataFrame:
    """Scan a catalog table or view, keeping only the declared columns."""
    return spark.table(table).select(*[f.name for f in declared(name)])


def load(spark: SparkSession, locations: dict[str, str], fmt: str = "csv") -> Tables:
    """Bundle the seven tables from paths (``csv``, ``parquet``) or table names (``table``)."""
    reader = {"csv": read_csv, "parquet": read_parquet, "table": read_catalog}[fmt]
    return Tables(**{name: reader(spark, locations[name], name) for name in SCHEMAS})
