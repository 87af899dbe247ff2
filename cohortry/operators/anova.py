"""Comparing groups: one- and two-way ANOVA, Levene, Tukey, Kruskal-Wallis and chi-square.

Each test first folds the rows into per-group moments or counts. What follows works on one row per group.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.functions.columns import ALPHA, effect_band
from cohortry.functions.tails import (
    chi2_tail_of,
    f_tail,
    f_tail_of,
    studentized_range_critical_of,
    studentized_range_tail_of,
)
from cohortry.operators.ranks import average_rank, beside, exact_quantiles, numeric_limits, range_of, running_totals
from cohortry.operators.summaries import restrict_to_top


def _group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: n, mean and sum of squares about the mean, computed without cancellation."""
    return (
        df.dropna(subset=[group, value])
        .groupBy(group)
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            (F.var_pop(value) * F.count(value)).alias("within"),
        )
    )


def one_way(df: DataFrame, group: str, value: str = "avg_order_value") -> DataFrame:
    """One row: n, group count, sums of squares, F, p, effect size and its band."""
    groups = _group_moments(df, group, value)
    all_groups = Window.partitionBy()  # one row per group
    grand = F.sum(F.col("n") * F.col("mean")).over(all_groups) / F.sum("n").over(all_groups)
    return (
        groups.withColumn("shift", F.col("mean") - grand)
        .agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("k"),
            F.sum(F.col("n") * F.col("shift") * F.col("shift")).alias("ss_between"),
            F.sum("within").alias("ss_within"),
        )
        .withColumn("df_between", F.col("k") - 1)
        .withColumn("df_within", F.col("n") - F.col("k"))
        .withColumn(
            "f",
            F.try_divide(
                F.try_divide("ss_between", "df_between"),
                F.try_divide("ss_within", "df_within"),
            ),
        )
        .withColumn("p", f_tail_of("f", F.col("df_between").cast("double"), F.col("df_within").cast("double")))
        .withColumn("eta_squared", F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")))
        .withColumn("effect", effect_band(F.col("eta_squared")))
        .withColumn("significant", F.col("p") < ALPHA)
    )


def factor_rows(features: DataFrame, factor: str) -> DataFrame:
    """The rows a factor is tested on: its ten most frequent levels, all levels for the payment type."""
    return features if factor == "preferred_payment" else restrict_to_top(features, factor)


def anova_of(features: DataFrame, factor: str) -> DataFrame:
    return one_way(factor_rows(features, factor), factor)


def anova_summary(features: DataFrame) -> DataFrame:
    """The three one-way analyses, one row each."""
    parts = [
        anova_of(features, factor).select(F.lit(factor).alias("factor"), "f", "p", "eta_squared", "significant")
        for factor in ("state", "favorite_category", "preferred_payment")
    ]
    return reduce(DataFrame.unionByName, parts)


def levene(df: DataFrame, group: str, value: str = "avg_order_value") -> DataFrame:
    """Homogeneity of variance: one-way analysis of the distances from the exact group medians."""
    known = df.dropna(subset=[group, value]).select(group, value)
    medians = exact_quantiles(known, [group], value, {"median": 0.5}).select(group, "median")
    spread = beside(known, medians, [group]).select(group, F.abs(F.col(value) - F.col("median")).alias("spread"))
    return one_way(spread, group, "spread").select(
        F.col("f").alias("w"), "df_between", "df_within", "p", (F.col("p") > ALPHA).alias("homogeneous")
    )


MOST_LEVELS = 1000
MOST_CELLS = 10_000


def tukey(df: DataFrame, group: str, value: str = "avg_order_value") -> DataFrame:
    """All pairs of groups by Tukey-Kramer: mean difference, error, q, adjusted p, interval, rejection.

    Pairs are made of group moments (one row per group), never of data rows. A factor with more than ``MOST_LEVELS`` levels
    is refused with an error when the table is computed: its pairs would be no report.
    """
    pooled = Window.partitionBy()  # one row per group
    too_many = F.raise_error(F.lit(f"{group} has more than {MOST_LEVELS} levels: too many for pairwise tests"))
    groups = _group_moments(df, group, value).select(
        F.when(F.count(F.lit(1)).over(pooled) > MOST_LEVELS, too_many).otherwise(F.col(group)).alias("level"),
        "n",
        "mean",
        F.count(F.lit(1)).over(pooled).alias("k"),
        (F.sum("n").over(pooled) - F.count(F.lit(1)).over(pooled)).alias("df"),
        (
            F.sum("within").over(pooled)
            / (F.sum("n").over(pooled) - F.count(F.lit(1)).over(pooled))
        ).alias("ms_within"),
    )
    a, b = groups.alias("a"), groups.alias("b")
    margin = F.col("q_crit") * F.col("std_error")
    return (
        a.join(b, F.col("a.level") < F.col("b.level"))
        .select(
            F.col("a.level").alias("group1"),
            F.col("b.level").alias("group2"),
            (F.col("b.mean") - F.col("a.mean")).alias("mean_diff"),
            F.sqrt(F.col("a.ms_within") / 2 * (1 / F.col("a.n") + 1 / F.col("b.n"))).alias("std_error"),
            F.col("a.k").cast("int").alias("k"),
            F.col("a.df").cast("double").alias("df"),
        )
        .withColumn("q", F.abs("mean_diff") / F.col("std_error"))
        .withColumn("p_adj", studentized_range_tail_of("q", "k", "df"))
        .withColumn("q_crit", studentized_range_critical_of("k", "df"))
        .select(
            "group1",
            "group2",
            "mean_diff",
            "std_error",
            "q",
            "df",
            "p_adj",
            (F.col("mean_diff") - margin).alias("lower"),
            (F.col("mean_diff") + margin).alias("upper"),
            (F.abs("mean_diff") > margin).alias("reject"),
        )
    )


def tukey_if_significant(df: DataFrame, group: str, value: str = "avg_order_value", alpha: float = ALPHA) -> DataFrame:
    """The pairs, only when the one-way analysis is significant; no rows otherwise."""
    gate = one_way(df, group, value).filter(F.col("p") < alpha).select(F.lit(1).alias("gate"))
    return tukey(df, group, value).withColumn("gate", F.lit(1)).join(F.broadcast(gate), "gate", "left_semi").drop("gate")


def rejected_pairs(pairs: DataFrame, rows: int = 10, alpha: float = ALPHA) -> DataFrame:
    """The first rejected pairs, each with the number of all that are rejected and of all pairs.

    The pairs are those of at most ``MOST_LEVELS`` levels, so counting them beside the rows is no large window.
    """
    all_pairs = Window.partitionBy()
    low = F.col("p_adj") < alpha
    counted = pairs.select("*", F.count_if(low).over(all_pairs).alias("rejected"), F.count(F.lit(1)).over(all_pairs).alias("pairs"))
    return counted.filter(low).orderBy("group1", "group2").limit(rows)


# The function for the cell table goes to its task by value, see the tails.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TWO_WAY_SCHEMA = "effect string, sum_sq double, df double, f double, p double"


def _explained(design: np.ndarray, n: np.ndarray, mean: np.ndarray) -> tuple[float, int]:
    """Weighted sum of squares left by a design over cell means, and the design's rank."""
    w = np.sqrt(n)
    beta, _, rank, _ = np.linalg.lstsq(design * w[:, None], mean * w, rcond=None)
    left = (mean - design @ beta) * w
    return float(left @ left), int(rank)


def _two_way_table(cells: pd.DataFrame) -> pd.DataFrame:
    """Type II effects from the cell table. Models are compared by the rank they have on the cells that exist."""
    n, mean = cells["n"].to_numpy(float), cells["mean"].to_numpy(float)
    one = np.ones((len(cells), 1))
    a = pd.get_dummies(cells["a"], dtype=float).to_numpy()
    b = pd.get_dummies(cells["b"], dtype=float).to_numpy()
    left_a, rank_a = _explained(np.hstack([one, a]), n, mean)
    left_b, rank_b = _explained(np.hstack([one, b]), n, mean)
    left_ab, rank_ab = _explained(np.hstack([one, a, b]), n, mean)
    residual = float(cells["within"].sum())
    residual_df = float(n.sum() - len(cells))
    effects = [
        ("a", left_b - left_ab, rank_ab - rank_b),
        ("b", left_a - left_ab, rank_ab - rank_a),
        ("a:b", left_ab, len(cells) - rank_ab),
    ]
    rows = []
    for name, ss, df in effects:
        f = (ss / df) / (residual / residual_df) if df > 0 and residual_df > 0 and residual > 0 else float("nan")
        rows.append((name, ss, float(df), f, f_tail(f, df, residual_df)))
    rows.append(("residual", residual, residual_df, float("nan"), float("nan")))
    return pd.DataFrame(rows, columns=["effect", "sum_sq", "df", "f", "p"])


def two_way(df: DataFrame, a: str, b: str, value: str = "avg_order_value") -> DataFrame:
    """Two-way analysis with interaction, Type II, from one row per cell.

    The rows fold into cells in one aggregation; the small least squares over the cells runs in one task. More than
    ``MOST_CELLS`` cells are refused with an error when the table is computed.
    """
    cells = (
        df.dropna(subset=[a, b, value])
        .groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            (F.var_pop(value) * F.count(value)).alias("within"),
        )
    )
    found = F.count(F.lit(1)).over(Window.partitionBy())  # one row per cell
    refuse = F.raise_error(F.lit(f"{a} and {b} have more than {MOST_CELLS} cells: too many for a two-way table"))
    cells = cells.withColumn("n", F.when(found > MOST_CELLS, refuse).otherwise(F.col("n")))
    names = F.create_map(F.lit("a"), F.lit(a), F.lit("b"), F.lit(b), F.lit("a:b"), F.lit(f"{a}:{b}"))
    return (
        cells.withColumn("table", F.lit(0))
        .groupBy("table")
        .applyInPandas(_two_way_table, _TWO_WAY_SCHEMA)
        .select(
            F.coalesce(names[F.col("effect")], "effect").alias("effect"),
            "sum_sq",
            "df",
            F.when(~F.isnan("f"), F.col("f")).alias("f"),
            F.when(~F.isnan("p"), F.col("p")).alias("p"),
            F.when(~F.isnan("p"), F.col("p") < ALPHA).alias("significant"),
        )
    )


def kruskal(df: DataFrame, group: str, value: str = "avg_order_value") -> DataFrame:
    """Rank test of equal distributions, corrected for ties.

    The rows are counted once, per (value, group); the counts per value, from which ranks follow, are sums of these.
    """
    known = df.dropna(subset=[group, value]).select(group, value)
    limits = numeric_limits(known, [value])[value]
    counted = known.groupBy(group, value).agg(F.count(F.lit(1)).alias("m"))
    per_value = counted.groupBy(value).agg(F.sum("m").alias("n"))
    positions = running_totals(per_value, [], value, ["n"], range_of(F.col(value), limits))
    ranks = positions.select(value, average_rank(F.col("n_before"), F.col("n")).alias("rank"))
    by_group = (
        counted.join(ranks, value)
        .groupBy(group)
        .agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("rank")).alias("rank_sum"))
        .agg(
            F.sum("m").alias("n"),
            F.count(F.lit(1)).alias("k"),
            F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("m")).alias("weighted"),
        )
    )
    t = F.col("n").cast("double")
    ties = positions.agg(F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("weighted") - 3 * (n + 1)
    return (
        by_group.select("*", ties.scalar().alias("ties"))
        .select(
            "n",
            "k",
            F.try_divide(raw, 1 - F.try_divide(F.col("ties"), n * n * n - n)).alias("h"),
            (F.col("k") - 1).alias("df"),
        )
        .withColumn("p", chi2_tail_of("h", F.col("df").cast("double")))
        .withColumn("significant", F.col("p") < ALPHA)
    )


def contingency(df: DataFrame, a: str = "is_repeat", b: str = "preferred_payment", levels=(0, 1)) -> DataFrame:
    """Observed and expected counts of every combination of the given levels of ``a`` with the values of ``b``.

    One row per value of ``b`` holds a count for each level, so combinations that do not occur are there as zero
    without pairing the two sides up. Levels without any row are left out.
    """
    wide = (
        df.dropna(subset=[b])
        .groupBy(b)
        .agg(F.array(*[F.count(F.when(F.col(a) == x, 1)) for x in levels]).alias("counts"))
        .withColumn("col_n", F.aggregate("counts", F.lit(0).cast("bigint"), lambda acc, x: acc + x))
    )
    cells = wide.select(
        b,
        "col_n",
        F.inline(F.arrays_zip(F.array(*[F.lit(x) for x in levels]).alias(a), F.col("counts").alias("observed"))),
    ).toDF(b, "col_n", a, "observed")
    # one row per cell from here on
    row_n = F.sum("observed").over(Window.partitionBy(a))
    total = F.sum("observed").over(Window.partitionBy())
    return (
        cells.select(a, b, "observed", (row_n * F.col("col_n") / total).alias("expected"))
        .filter(F.col("expected") > 0)
    )


def chi2_independence(df: DataFrame, a: str = "is_repeat", b: str = "preferred_payment") -> DataFrame:
    """Chi-square test of independence with Cramer's V. One degree of freedom takes the continuity correction."""
    cells = contingency(df, a, b)
    rows, cols = F.count_distinct(a), F.count_distinct(b)
    gap = F.abs(F.col("observed") - F.col("expected"))
    corrected = gap - F.least(F.lit(0.5), gap)
    sums = cells.agg(
        F.sum("observed").alias("n"),
        ((rows - 1) * (cols - 1)).alias("df"),
        (F.least(rows, cols) - 1).alias("min_dim"),
        F.sum(gap * gap / F.col("expected")).alias("plain"),
        F.sum(corrected * corrected / F.col("expected")).alias("corrected"),
    )
    return (
        sums.withColumn("chi2", F.when(F.col("df") == 1, F.col("corrected")).otherwise(F.col("plain")))
        .withColumn("p", F.when(F.col("df") == 0, F.lit(1.0)).otherwise(chi2_tail_of("chi2", F.col("df").cast("double"))))
        .withColumn("cramers_v", F.sqrt(F.try_divide("chi2", F.col("n") * F.col("min_dim"))))
        .select("n", "chi2", "df", "p", "cramers_v", (F.col("p") < ALPHA).alias("significant"))
    )
