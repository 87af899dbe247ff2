"""The tables behind the charts: box-plot statistics, samples for scatter plots, coefficient arms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.ranks import beside, exact_quantiles
from cohortry.operators.regression import INTERCEPT
from cohortry.operators.splits import SEED, shuffle_key

SAMPLE_ROWS = 5000
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
WHISKER = 1.5


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers (the outermost values within 1.5 interquartile ranges) and the number of outliers.

    Quartiles are exact, between neighbouring values by interpolation. Rows are put in order near a quartile only; the rest is
    one aggregation that combines before its shuffle. Null keys and values take no part.
    """
    keys = list(keys)
    quartiles = exact_quantiles(df, keys, value, QUARTILES)
    known = beside(df.dropna(subset=[*keys, value]).select(*keys, value), quartiles.drop("n"), keys)
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(q).alias(q) for q in QUARTILES],
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def sample_rows(df: DataFrame, columns: Sequence[str], key: str, rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """The same ``rows`` rows on every run, chosen by a hash of the key."""
    return (
        df.select(key, *columns, shuffle_key(key, seed).alias("_hash")).orderBy("_hash", key).limit(rows).drop("_hash")
    )


def coefficient_arms(table: DataFrame, estimate: str) -> DataFrame:
    """Estimates with the lengths of their interval arms, without the intercept."""
    return table.filter(F.col("term") != INTERCEPT).select(
        "term",
        estimate,
        (F.col(estimate) - F.col("lower")).alias("arm_low"),
        (F.col("upper") - F.col(estimate)).alias("arm_high"),
        "mark",
    )
