"""Base tables stored in the catalog by key, so that joins and folds on the key need no shuffle."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cohortry.session import shuffle_width
from cohortry.sources.tables import Tables, load

# The key each table is bucketed and sorted by. The two dimension tables are small and have no bucket.
KEYS = {
    "orders": "order_id",
    "customers": "customer_id",
    "order_items": "order_id",
    "order_reviews": "order_id",
    "order_payments": "order_id",
}


def save_keyed(tables: Tables, prefix: str, folder: str | None = None, buckets: int | None = None) -> dict[str, str]:
    """Write the base tables as catalog tables ``<prefix>_<name>`` and return their names.

    Tables with an order carry ``buckets`` buckets by ``order_id``, sorted within: rows of an order stand in one bucket of each table, so
    folding and joining them later reads bucket by bucket. Choose as many buckets as the largest join wants tasks, and no fewer than the
    shuffle width of the sessions that read them (the default), or Spark shuffles for more parallelism after all. Rows are dealt by key before they are written, so that each bucket is one file. ``folder``
    makes the tables external, below that path; else they go to the warehouse.
    """
    spark = tables.orders.sparkSession
    count = buckets or shuffle_width(spark)
    names = {}
    for name, df in tables.named().items():
        names[name] = f"{prefix}_{name}"
        key = KEYS.get(name)
        writer = (df.repartition(count, key) if key else df).write.mode("overwrite").format("parquet")
        if key:
            writer = writer.bucketBy(count, key).sortBy(key)
        if folder:
            writer = writer.option("path", f"{folder.rstrip('/')}/{name}")
        writer.saveAsTable(names[name])
    return names


def load_keyed(spark: SparkSession, prefix: str) -> Tables:
    """The bundle of tables that :func:`save_keyed` wrote."""
    return load(spark, {name: f"{prefix}_{name}" for name in Tables.__dataclass_fields__}, "table")
