"""Counts, group descriptions, cross-tabulations, comparisons and reports over the customer feature table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.sources.tables import Tables

# Labels of the two customer kinds and the metrics they are compared on.
SINGLE_LABEL = "單次客"
REPEAT_LABEL = "回購客"
COMPARED_METRICS = [
    "avg_delay_days",
    "avg_freight_ratio",
    "avg_review_score",
    "avg_payment_installments",
    "avg_order_value",
]
TOP_LEVELS = 10


def row_counts(t: Tables) -> DataFrame:
    """Number of rows of every base table."""
    counts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n")) for name, df in t.named().items()]
    return reduce(DataFrame.unionByName, counts)


def preview(df: DataFrame, key: str, rows: int = 5) -> DataFrame:
    """The first rows in key order."""
    return df.orderBy(key).limit(rows)


def top_levels(features: DataFrame, factor: str, rows: int = TOP_LEVELS) -> DataFrame:
    """The most frequent values of a column with their counts; ties by name. ``rows`` rows at most."""
    return (
        features.filter(F.col(factor).isNotNull())
        .groupBy(factor)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), factor)
        .limit(rows)
    )


def restrict_to_top(features: DataFrame, factor: str, rows: int = TOP_LEVELS) -> DataFrame:
    """Rows whose factor is among its most frequent values.

    The names, ``rows`` at most, are found at once and go into the plan as a list, so the restriction reaches the scan and is not
    computed again by each use of the result.
    """
    names = [r[0] for r in top_levels(features, factor, rows).select(factor).collect()]
    return features.filter(F.col(factor).isin(names) if names else F.lit(False))


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count of known values, mean and sample deviation (null for a single row) per key combination."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    )


def with_repeat_label(features: DataFrame) -> DataFrame:
    return features.withColumn(
        "repeat_label", F.when(F.col("is_repeat") == 1, REPEAT_LABEL).when(F.col("is_repeat") == 0, SINGLE_LABEL)
    )


def two_way_describe(features: DataFrame) -> DataFrame:
    known = features.dropna(subset=["avg_order_value", "is_repeat", "preferred_payment"])
    return describe(with_repeat_label(known), ["repeat_label", "preferred_payment"], "avg_order_value")


def interaction_means(features: DataFrame, levels: Sequence | None = None) -> DataFrame:
    """Mean order value per payment type, one column per customer kind."""
    known = features.dropna(subset=["avg_order_value", "preferred_payment"])
    return (
        known.groupBy("preferred_payment")
        .pivot("is_repeat", list(levels or [0, 1]))
        .agg(F.avg("avg_order_value"))
        .select("preferred_payment", F.col("0").alias("single_mean"), F.col("1").alias("repeat_mean"))
    )


def crosstab(features: DataFrame, column: str = "preferred_payment") -> DataFrame:
    """Customers by a column's value and by kind, zero where a combination does not occur."""
    return (
        features.dropna(subset=[column, "is_repeat"])
        .groupBy(column)
        .pivot("is_repeat", [0, 1])
        .agg(F.count(F.lit(1)))
        .select(
            column,
            F.coalesce("0", F.lit(0)).alias("single_n"),
            F.coalesce("1", F.lit(0)).alias("repeat_n"),
        )
    )


def repeat_share(features: DataFrame) -> DataFrame:
    """Customers by kind and the share of each. The total rides along as a second grouping level of the same pass."""
    return features.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(1 - F.col("is_repeat")).alias("single_n"),
        F.sum("is_repeat").alias("repeat_n"),
        F.avg(1.0 - F.col("is_repeat")).alias("single_share"),
        F.avg("is_repeat").alias("repeat_share"),
    )


def segment_compare(features: DataFrame, metrics: Sequence[str] = COMPARED_METRICS) -> DataFrame:
    """Metric means of single and repeat customers and the difference in percent, one row per metric."""
    means = features.agg(
        *[
            F.avg(F.when(F.col("is_repeat") == kind, F.col(m))).alias(f"{m}_{kind}")
            for m in metrics
            for kind in (0, 1)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(f"{m}_0").alias("single"), F.col(f"{m}_1").alias("repeat"))
            for m in metrics
        ]
    )
    return means.select(F.inline(rows)).withColumn(
        "difference_pct", F.try_divide(F.col("repeat") - F.col("single"), F.col("single")) * 100
    )


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """Results of any shape as one long table (section, row, metric, value), ready for a sink.

    Meant for result tables: the row label is made of a row's text columns, the metrics are its numbers.
    """

    def long(section: str, df: DataFrame) -> DataFrame:
        numeric = [n for n, kind in df.dtypes if kind in ("double", "float", "int", "bigint", "smallint", "tinyint")]
        labels = [n for n in df.columns if n not in numeric]
        entries = F.array(
            *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in numeric]
        )
        label = F.concat_ws(" / ", *[F.col(n).cast("string") for n in labels]) if labels else F.lit("")
        return df.select(F.lit(section).alias("section"), label.alias("row"), F.inline(entries))

    return reduce(DataFrame.unionByName, [long(name, df) for name, df in sections.items()])
