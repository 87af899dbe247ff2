"""Exact, repeatable hold-out splits and folds.

Rows are ordered by a hash of their key and a seed (hold-outs) or by the key itself (folds), and the cut is placed by
position. Positions come from ordered ranges, so no task orders more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.operators.ranks import key_limits, range_of
from cohortry.session import range_count

TEST_SHARE_PERCENT = 30
SEED = 42
FOLDS = 5


def shuffle_key(key: str, seed: int = SEED) -> Column:
    """A hash that puts rows in an order unrelated to their content, the same on every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def _hash_range(hashed: Column, width: int) -> Column:
    """Even ranges of the leading 32 bits of a hexadecimal hash."""
    lead = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint")
    return F.floor(lead * width / (1 << 32)).cast("int")


def positions(df: DataFrame, classes: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Number the rows of each class from 1 in the given order, and add the class size.

    ``bucket`` must grow with the order. The table of range sizes has one row per class and range.
    """
    placed = df.withColumn("_range", bucket)
    earlier = Window.partitionBy(*classes).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*classes, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *classes,
            "_range",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
            F.sum("_n").over(Window.partitionBy(*classes)).alias("class_n"),
        )
    )
    inside = Window.partitionBy(*classes, "_range").orderBy(*order)
    return (
        placed.withColumn("_in", F.row_number().over(inside))
        .join(starts, [*classes, "_range"])
        .select(*df.columns, (F.col("_start") + F.col("_in")).alias("position"), "class_n")
    )


def _test_quotas(sizes: DataFrame, label: str) -> DataFrame:
    """Test rows per class so that they add up to the rounded-up share of all rows.

    The training rows are dealt out in proportion, rounded down; what is left goes to the largest remainders. One
    row per class.
    """
    every = Window.partitionBy()
    n = F.sum("class_n").over(every)
    n_train = n - F.ceil(n * TEST_SHARE_PERCENT / 100)
    dealt = F.floor(n_train * F.col("class_n") / n)
    parts = sizes.select(
        label, "class_n", n_train.alias("n_train"), dealt.alias("dealt"),
        (n_train * F.col("class_n") % n).alias("remainder"),
    )
    spare = F.col("n_train") - F.sum("dealt").over(every)
    place = F.row_number().over(Window.orderBy(F.desc("remainder"), label))
    return parts.select(
        label, (F.col("class_n") - F.col("dealt") - (place <= spare).cast("int")).alias("quota")
    )


def holdout(df: DataFrame, key: str = "customer_unique_id", label: str | None = None, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: exactly ceil(30 %) of the rows, with the classes of ``label`` in proportion if given."""
    hashed = df.withColumn("_hash", shuffle_key(key, seed))
    classes = [label] if label else []
    placed = positions(hashed, classes, ["_hash", key], _hash_range(F.col("_hash"), range_count(df.sparkSession, df.count())))
    if label is None:
        quota = F.ceil(F.col("class_n") * TEST_SHARE_PERCENT / 100)
        return placed.select(*df.columns, (F.col("position") <= quota).cast("int").alias("is_test"))
    quotas = _test_quotas(df.groupBy(label).agg(F.count(F.lit(1)).alias("class_n")), label)
    return placed.join(F.broadcast(quotas), label).select(
        *df.columns, (F.col("position") <= F.col("quota")).cast("int").alias("is_test")
    )


def sampled_holdout(
    df: DataFrame, key: str = "customer_unique_id", label: str | None = None, percent: float | dict = TEST_SHARE_PERCENT, seed: int = SEED
) -> DataFrame:
    """Add ``is_test`` in one pass, without order or shuffle: each row is drawn by the hash of its key alone.

    ``percent`` is one share, or one for each class of ``label`` (classes not named, and null, are never drawn). A share p of a class of n
    rows is met up to a standard deviation of sqrt(p (1 - p) / n), see :func:`sample_shares`; where it must be exact, use
    :func:`holdout`. Equal keys are drawn alike; a null key is never drawn.
    """
    draw = F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("bigint")

    def limit(share: float) -> Column:
        return F.lit(round(share * (1 << 32) / 100))

    if isinstance(percent, dict):
        bound = F.lit(0)
        for level, share in percent.items():
            bound = F.when(F.col(label) == level, limit(share)).otherwise(bound)
    else:
        bound = limit(percent)
    return df.withColumn("is_test", (F.col(key).isNotNull() & (draw < bound)).cast("int"))


def sample_shares(marked: DataFrame, label: str) -> DataFrame:
    """Per class of a sampled hold-out: rows, held-out rows, their share in percent and its standard deviation."""
    p = F.col("test_n") / F.col("n")
    return (
        marked.groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("is_test").alias("test_n"))
        .select(label, "n", "test_n", (100 * p).alias("percent"), (100 * F.sqrt(p * (1 - p) / F.col("n"))).alias("percent_sd"))
    )


def stratified_folds(df: DataFrame, label: str, key: str = "customer_unique_id", folds: int = FOLDS) -> DataFrame:
    """Add ``fold``: consecutive blocks in key order within each class, sized as a deal of the sorted classes.

    Lining the classes up one after another and dealing the rows round-robin gives each fold its number of rows of
    each class; the class that appears first in key order comes first.
    """
    placed = positions(df, [label], [key], range_of(F.col(key), key_limits(df, key)))
    line = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    starts = (
        df.groupBy(label)
        .agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(label, F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_at"))
    )
    placed = placed.join(F.broadcast(starts), label)

    def dealt_to(fold: int) -> Column:
        # rows of this class at places p with p % folds <= fold
        def up_to(place: Column) -> Column:
            return F.floor(place / folds) * (fold + 1) + F.least(place % folds, F.lit(fold + 1))

        return up_to(F.col("_at") + F.col("class_n")) - up_to(F.col("_at"))

    fold = F.lit(folds - 1)
    for i in reversed(range(folds - 1)):
        fold = F.when(F.col("position") <= dealt_to(i), i).otherwise(fold)
    return placed.select(*df.columns, fold.alias("fold"))
