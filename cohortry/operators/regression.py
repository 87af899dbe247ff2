"""Linear regression with its inference table, fit statistics, collinearity and residual diagnostics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.functions import tails
from cohortry.functions.columns import ALPHA, SIGNIFICANCE_MARKS, normal_quantile
from cohortry.functions.gram import MOST_SUMS, product_sums
from cohortry.operators.ranks import key_limits, range_of, value_positions

TARGET = "avg_order_value"
PREDICTORS = [
    "avg_delay_days",
    "avg_freight_ratio",
    "avg_review_score",
    "avg_payment_installments",
    "avg_item_count",
]
INTERCEPT = "intercept"
VIF_LIMIT = 10.0
HISTOGRAM_BINS = 50
RUN = 4096  # equal values unrolled together
KEY = "customer_unique_id"


def mark_of(p: float) -> str:
    return next((mark for level, mark in SIGNIFICANCE_MARKS if p < level), "")


@dataclass(frozen=True)
class LinearFit:
    """A least-squares fit, held as the first and second moments of the data: (k + 2)(k + 3) / 2 numbers."""

    target: str
    predictors: tuple[str, ...]
    n: int
    means: np.ndarray  # predictors, then target
    cov: np.ndarray

    @property
    def k(self) -> int:
        return len(self.predictors)

    @property
    def slopes(self) -> np.ndarray:
        return np.linalg.solve(self.cov[:-1, :-1], self.cov[:-1, -1])

    @property
    def intercept(self) -> float:
        return float(self.means[-1] - self.means[:-1] @ self.slopes)

    @property
    def r_squared(self) -> float:
        return float(self.slopes @ self.cov[:-1, -1] / self.cov[-1, -1])

    @property
    def residual_df(self) -> int:
        return self.n - self.k - 1

    @property
    def residual_ss(self) -> float:
        return float((self.n - 1) * self.cov[-1, -1] * (1 - self.r_squared))

    @property
    def standard_errors(self) -> np.ndarray:
        """Of the intercept, then of the slopes."""
        variance = self.residual_ss / self.residual_df
        inverse = np.linalg.inv(self.cov[:-1, :-1]) / (self.n - 1)
        centre = self.means[:-1]
        return np.sqrt(variance * np.concatenate([[1 / self.n + centre @ inverse @ centre], np.diag(inverse)]))

    @property
    def vif(self) -> np.ndarray:
        sd = np.sqrt(np.diag(self.cov)[:-1])
        return np.diag(np.linalg.inv(self.cov[:-1, :-1] / np.outer(sd, sd)))

    @property
    def condition_number(self) -> float:
        """Of the design matrix with its constant, from its uncentred cross products."""
        full = np.concatenate([[1.0], self.means[:-1]])
        gram = self.n * np.outer(full, full)
        gram[1:, 1:] += (self.n - 1) * self.cov[:-1, :-1]
        eigenvalues = np.linalg.eigvalsh(gram)
        return float(math.sqrt(eigenvalues[-1] / eigenvalues[0]))

    def prediction(self) -> Column:
        terms = [F.lit(float(b)) * F.col(x) for b, x in zip(self.slopes, self.predictors)]
        return reduce(lambda total, term: total + term, terms, F.lit(self.intercept))


def complete_rows(df: DataFrame, predictors: Sequence[str] = PREDICTORS, target: str = TARGET) -> DataFrame:
    return df.dropna(subset=[*predictors, target])


def fit_linear(df: DataFrame, predictors: Sequence[str] = PREDICTORS, target: str = TARGET) -> LinearFit:
    """One aggregation over the complete rows; the small system is solved where its moments arrive.

    With more moments than generated code takes, a first pass finds the means and a second the products of deviations from them.
    """
    names = [*predictors, target]
    k, rows = len(names), complete_rows(df, predictors, target)
    n, means = F.count(F.lit(1)).alias("n"), [F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]
    pairs = list(combinations_with_replacement(range(k), 2))
    if 1 + k + len(pairs) > MOST_SUMS:
        row = rows.agg(n, *means).first()
        mean = [row[f"m{i}"] for i in range(k)]
        shifted = [(F.col(c) - F.lit(m)).cast("double").alias(f"d{i}") for i, (c, m) in enumerate(zip(names, mean))]
        one = rows.select(F.lit(0).alias("key"), F.lit(1.0).alias("w"), *shifted)
        products, _ = product_sums(one, "key", ["w"], [f"d{i}" for i in range(k)])[0]
        rest = products[0, 1:] / row["n"]  # what rounding left in the means
        cov = (products[1:, 1:] - row["n"] * np.outer(rest, rest)) / (row["n"] - 1)
        return LinearFit(target, tuple(predictors), row["n"], np.array(mean) + rest, cov)
    row = rows.agg(n, *means, *[F.covar_samp(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return LinearFit(target, tuple(predictors), row["n"], np.array([row[f"m{i}"] for i in range(k)]), cov)


def coefficient_table(spark: SparkSession, fit: LinearFit) -> DataFrame:
    """Per term: B, error, t, p, 95 % interval, mark and standardised coefficient (none for the intercept)."""
    reach = tails.t_critical(fit.residual_df)
    sd = np.sqrt(np.diag(fit.cov))
    betas = [None, *[float(b * s / sd[-1]) for b, s in zip(fit.slopes, sd)]]
    rows = []
    for term, b, se, beta in zip(
        [INTERCEPT, *fit.predictors], [fit.intercept, *fit.slopes], fit.standard_errors, betas
    ):
        b, se = float(b), float(se)
        p = tails.t_two_sided(b / se, fit.residual_df)
        rows.append((term, b, se, b / se, p, b - reach * se, b + reach * se, mark_of(p), beta))
    return spark.createDataFrame(
        rows,
        "term string, b double, std_error double, t double, p double, lower double, upper double, mark string, "
        "beta double",
    )


def significant_terms(coefficients: DataFrame) -> DataFrame:
    """Terms other than the intercept with p < 0.05 and the direction of their effect."""
    return coefficients.filter((F.col("p") < ALPHA) & (F.col("term") != INTERCEPT)).select(
        "term", "b", F.when(F.col("b") > 0, "positive").otherwise("negative").alias("direction")
    )


def vif_table(spark: SparkSession, fit: LinearFit) -> DataFrame:
    rows = [(x, float(v), bool(v > VIF_LIMIT)) for x, v in zip(fit.predictors, fit.vif)]
    return spark.createDataFrame(rows, "variable string, vif double, collinear boolean")


def fit_table(spark: SparkSession, fit: LinearFit) -> DataFrame:
    """R squared, adjusted R squared, F with its p, likelihood and information criteria, condition number."""
    r2, n, k = fit.r_squared, fit.n, fit.k
    f = (r2 / k) / ((1 - r2) / fit.residual_df)
    log_likelihood = -n / 2 * (math.log(2 * math.pi) + math.log(fit.residual_ss / n) + 1)
    row = (
        n, r2, 1 - (1 - r2) * (n - 1) / fit.residual_df, f, tails.f_tail(f, k, fit.residual_df), log_likelihood,
        -2 * log_likelihood + 2 * (k + 1), -2 * log_likelihood + math.log(n) * (k + 1), fit.condition_number,
    )
    return spark.createDataFrame(
        [row],
        "n bigint, r_squared double, adj_r_squared double, f double, f_p double, log_likelihood double, aic double, "
        "bic double, condition_number double",
    )


def with_residuals(df: DataFrame, fit: LinearFit) -> DataFrame:
    """Complete rows with ``fitted`` and ``residual``."""
    return (
        complete_rows(df, fit.predictors, fit.target)
        .withColumn("fitted", fit.prediction())
        .withColumn("residual", F.col(fit.target) - F.col("fitted"))
    )


def _skew_z(skew: float, n: int) -> float:
    """Normal score of a sample skewness (D'Agostino 1970)."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    scale = math.sqrt(2.0 / (w2 - 1))
    return math.asinh(y / scale) / math.sqrt(0.5 * math.log(w2))


def _kurtosis_z(kurtosis: float, n: int) -> float:
    """Normal score of a sample kurtosis (Anscombe and Glynn 1983)."""
    mean = 3.0 * (n - 1) / (n + 1)
    variance = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3.0) * (n + 5))
    x = (kurtosis - mean) / math.sqrt(variance)
    skew = (
        6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    )
    a = 6.0 + 8.0 / skew * (2.0 / skew + math.sqrt(1 + 4.0 / skew**2))
    denominator = 1 + x * math.sqrt(2 / (a - 4.0))
    root = math.copysign(abs((1 - 2.0 / a) / denominator) ** (1 / 3.0), denominator)
    return (1 - 2.0 / (9 * a) - root) / math.sqrt(2.0 / (9 * a))


def residual_statistics(spark: SparkSession, residuals: DataFrame) -> DataFrame:
    """Mean, deviation, skewness and kurtosis of the residuals, with the Omnibus and Jarque-Bera normality tests."""
    row = residuals.agg(
        F.count("residual").alias("n"),
        F.avg("residual").alias("mean"),
        F.stddev_samp("residual").alias("sd"),
        F.skewness("residual").alias("skew"),
        (F.kurtosis("residual") + 3).alias("kurtosis"),
    ).first()
    n, skew, kurtosis = row["n"], row["skew"], row["kurtosis"]
    jarque_bera = n / 6 * (skew**2 + (kurtosis - 3) ** 2 / 4)
    omnibus = _skew_z(skew, n) ** 2 + _kurtosis_z(kurtosis, n) ** 2
    values = (
        n, row["mean"], row["sd"], skew, kurtosis, omnibus, tails.chi2_tail(omnibus, 2), jarque_bera,
        tails.chi2_tail(jarque_bera, 2),
    )
    return spark.createDataFrame(
        [values],
        "n bigint, mean double, sd double, skew double, kurtosis double, omnibus double, omnibus_p double, "
        "jarque_bera double, jarque_bera_p double",
    )


def durbin_watson(residuals: DataFrame, key: str = KEY) -> DataFrame:
    """Squared steps between neighbours in key order over squared residuals.

    Neighbours are found inside key ranges; each range hands over only its first and last residual, and the steps
    between ranges are added from that table of one row per range.
    """
    placed = residuals.select(
        key, "residual", range_of(F.col(key), key_limits(residuals, key)).alias("_range")
    )
    step = F.col("residual") - F.lag("residual").over(Window.partitionBy("_range").orderBy(key))
    ranges = (
        placed.withColumn("step", step)
        .groupBy("_range")
        .agg(
            F.sum(F.col("step") * F.col("step")).alias("steps"),
            F.sum(F.col("residual") * F.col("residual")).alias("squares"),
            F.min_by("residual", key).alias("first"),
            F.max_by("residual", key).alias("last"),
        )
    )
    across = F.col("first") - F.lag("last").over(Window.orderBy("_range"))
    return ranges.withColumn("across", F.coalesce(across * across, F.lit(0.0))).agg(
        ((F.sum(F.coalesce("steps", F.lit(0.0))) + F.sum("across")) / F.sum("squares")).alias("durbin_watson")
    )


def holdout_metrics(split: DataFrame, predictors: Sequence[str] = PREDICTORS, target: str = TARGET) -> DataFrame:
    """Fit on the training rows of a split (``is_test``) and measure R squared, RMSE and MAE on both parts."""
    fit = fit_linear(split.filter("is_test = 0"), predictors, target)
    scored = with_residuals(split, fit)
    squared = F.col("residual") * F.col("residual")
    return (
        scored.groupBy(F.when(F.col("is_test") == 1, "test").otherwise("train").alias("part"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            (1 - F.sum(squared) / (F.var_pop(target) * F.count(target))).alias("r_squared"),
            F.sqrt(F.avg(squared)).alias("rmse"),
            F.avg(F.abs("residual")).alias("mae"),
        )
    )


def residual_histogram(residuals: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal bins from the smallest to the largest residual; bins without residuals have no row."""
    low, high = residuals.agg(F.min("residual"), F.max("residual")).first()
    width = (high - low) / bins or 1.0
    bin_of = F.least(F.floor((F.col("residual") - low) / width), F.lit(bins - 1)).cast("int")
    return (
        residuals.groupBy(bin_of.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin", (F.lit(low) + F.col("bin") * width).alias("bin_from"),
            (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_to"), "n",
        )
    )


def qq_points(residuals: DataFrame) -> DataFrame:
    """Residuals in order against the normal quantiles of their median positions (Filliben 1975).

    Positions come from the counts of distinct residuals. Runs of equal residuals are cut into short stretches that
    are spread over the tasks before they are unrolled, so a long run is no burden to any one of them.
    """
    n = F.col("n_all")
    end = F.pow(F.lit(0.5), 1 / n)

    def position(i: Column) -> Column:
        return F.when(i == 1, 1 - end).when(i == n, end).otherwise((i - 0.3175) / (n + 0.365))

    first, last = F.col("n_before") + 1, F.col("n_before") + F.col("n")
    stretches = (
        value_positions(residuals, [], "residual")
        .select("residual", "n_all", last.alias("last"), F.explode(F.sequence(first, last, F.lit(RUN))).alias("start"))
        .repartition("start")
    )
    return stretches.select(
        "residual",
        "n_all",
        F.explode(F.sequence("start", F.least(F.col("start") + (RUN - 1), F.col("last")))).alias("i"),
    ).select("i", "residual", normal_quantile(position(F.col("i"))).alias("theoretical"))


def qq_fit(points: DataFrame) -> DataFrame:
    """Line through the normal plot: slope, intercept and correlation."""
    return points.agg(
        F.regr_slope("residual", "theoretical").alias("slope"),
        F.regr_intercept("residual", "theoretical").alias("intercept"),
        F.corr("theoretical", "residual").alias("r"),
    )
