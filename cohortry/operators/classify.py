"""Logistic regression: inference on the odds, a balanced classifier, and its evaluation on held-out rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions import tails
from cohortry.functions.columns import ALPHA
from cohortry.functions.gram import MOST_SUMS, product_sums
from cohortry.operators.ranks import numeric_limits, range_of, running_totals
from cohortry.operators.regression import INTERCEPT, mark_of
from cohortry.operators.splits import FOLDS, stratified_folds
from cohortry.sources.scratch import keep

LABEL = "is_repeat"
PREDICTORS = [
    "avg_delay_days",
    "avg_freight_ratio",
    "avg_review_score",
    "avg_payment_installments",
    "avg_order_value",
]
THRESHOLD = 0.5
INVERSE_PENALTY = 1.0  # the classifier's C
SINGULAR = 1e14  # condition number from which a system counts as singular


def complete_rows(df: DataFrame, predictors: Sequence[str] = PREDICTORS, label: str = LABEL) -> DataFrame:
    return df.dropna(subset=[*predictors, label])


def row_usage(df: DataFrame, predictors: Sequence[str] = PREDICTORS, label: str = LABEL) -> DataFrame:
    """How many rows a model uses: all, complete, dropped, and the complete ones by class with the share of class 1."""
    complete = reduce(lambda both, c: both & c, [F.col(x).isNotNull() for x in [*predictors, label]])
    return df.agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.count_if(complete).alias("complete_rows"),
        F.count_if(~complete).alias("dropped_rows"),
        F.count_if(complete & (F.col(label) == 0)).alias("single_n"),
        F.count_if(complete & (F.col(label) == 1)).alias("repeat_n"),
        F.avg(F.when(complete, F.col(label))).alias("repeat_share"),
    )


@dataclass(frozen=True)
class Scale:
    """Means and deviations of the predictors: two numbers each."""

    means: dict[str, float]
    sds: dict[str, float]

    def z(self, name: str) -> Column:
        return (F.col(name) - F.lit(self.means[name])) / F.lit(self.sds[name])


def population_scale(df: DataFrame, predictors: Sequence[str] = PREDICTORS) -> Scale:
    """Mean and population deviation; a constant column is left at its scale."""
    row = df.agg(
        *[F.avg(x).alias(f"m_{x}") for x in predictors], *[F.stddev_pop(x).alias(f"s_{x}") for x in predictors]
    ).first()
    return Scale({x: row[f"m_{x}"] for x in predictors}, {x: row[f"s_{x}"] or 1.0 for x in predictors})


# --- fitting ---------------------------------------------------------------------------------------------------


def _newton_sums(rows: DataFrame, names: Sequence[str], beta: Sequence[Column]) -> list[tuple[int, float, np.ndarray, np.ndarray]]:
    """Per model what one Newton step needs: log-likelihood, gradient and information.

    The linear predictor, and what follows from it, are computed once per row below the aggregation. More sums than generated code
    takes are formed as blocks of products.
    """
    terms = [beta[0], *[b * F.col(n) for b, n in zip(beta[1:], names)]]
    staged = (
        rows.withColumn("eta", reduce(lambda total, term: total + term, terms))
        .withColumn("p", 1 / (1 + F.exp(-F.col("eta"))))
        .select(
            "model",
            *names,
            F.expr("w * (y * eta - greatest(eta, 0D) - log1p(exp(-abs(eta))))").alias("l"),
            F.expr("w * (y - p)").alias("gap"),
            F.expr("w * p * (1 - p)").alias("curve"),
        )
    )
    k = len(names)
    if (k + 1) * (k + 4) // 2 + 1 > MOST_SUMS:
        blocks = product_sums(staged, "model", ["curve", "gap", "l"], names)
        return [(m, float(rest[1, 0]), rest[0], information) for m, (information, rest) in blocks.items()]
    x = ["1D", *names]
    sums = ["sum(l) AS ll"]
    for i, xi in enumerate(x):
        sums.append(f"sum(gap * {xi}) AS g{i}")
        sums += [f"sum(curve * {xi} * {x[j]}) AS h{i}_{j}" for j in range(i, k + 1)]
    out = []
    for row in staged.groupBy("model").agg(*[F.expr(e) for e in sums]).collect():
        upper = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
        out.append((row["model"], row["ll"], np.array([row[f"g{i}"] for i in range(k + 1)]), upper))
    return out


class NotConverged(RuntimeError):
    """A likelihood has no maximum that the steps could reach."""


def newton_fits(
    rows: DataFrame,
    z: Sequence[Column],
    label: str,
    models: int = 1,
    model: Column | None = None,
    weight: Column | None = None,
    penalty: float = 0.0,
    steps: int = 50,
    tol: float = 1e-11,
) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Maximise the (penalised, weighted) likelihood of several logistic models at once.

    ``model`` gives the models a row trains, as an array of indices; by default the single model 0. ``weight`` is an
    array with the row's weight in each model. Every step is one
    aggregation grouped by model, so all models share its pass over the data, and only sums, about k^2 a model, reach the driver. The intercept is not penalised. Returns coefficients (intercept first), information matrix
    and log-likelihood per model. A step that lowers the likelihood is halved. A fit that has not settled after ``steps``
    steps, or whose classes a predictor separates, raises ``NotConverged``.
    """
    k = len(z)
    names = [f"z{i}" for i in range(k)]
    data = rows.select(
        (F.array(F.lit(0)) if model is None else model).alias("models"),
        F.col(label).cast("double").alias("y"),
        (F.array(*[F.lit(1.0)] * models) if weight is None else weight).alias("w"),
        *[c.alias(n) for c, n in zip(z, names)],
    ).persist(StorageLevel.MEMORY_AND_DISK)
    per_model = data.select(F.explode("models").alias("model"), "y", "w", *names).withColumn(
        "w", F.element_at("w", F.col("model") + 1)
    )
    try:
        return _climb(per_model, names, models, np.diag([0.0] + [penalty] * k), steps, tol)
    finally:
        data.unpersist()


def _climb(
    per_model: DataFrame, names: Sequence[str], models: int, ridge: np.ndarray, steps: int, tol: float
) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Newton steps of all models until none moves."""
    k = len(names)
    beta = np.zeros((models, k + 1))
    before, best = beta.copy(), np.full(models, -np.inf)
    information = np.zeros((models, k + 1, k + 1))
    likelihood = np.zeros(models)
    for _ in range(steps):
        current = [F.element_at(F.lit([float(v) for v in beta[:, i]]), F.col("model") + 1) for i in range(k + 1)]
        moved = 0.0
        for m, ll, gradient, curvature in _newton_sums(per_model, names, current):
            objective = ll - beta[m] @ ridge @ beta[m] / 2
            if objective < best[m] - 1e-12 * abs(best[m]):
                beta[m] = (beta[m] + before[m]) / 2
                moved = math.inf
                continue
            information[m] = curvature
            gradient = gradient - ridge @ beta[m]
            likelihood[m], best[m], before[m] = ll, objective, beta[m].copy()
            if not np.linalg.cond(information[m] + ridge) < SINGULAR:
                raise NotConverged(f"model {m}: singular information; predictors separate the classes or repeat each other")
            step = np.linalg.solve(information[m] + ridge, gradient)
            beta[m] = beta[m] + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < tol:
            return [(beta[m], information[m], float(likelihood[m])) for m in range(models)]
    raise NotConverged(f"no maximum within {steps} steps; predictors may separate the classes")


# --- inference -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LogitFit:
    predictors: tuple[str, ...]
    n: int
    coefficients: list[float]  # intercept first
    standard_errors: list[float]
    log_likelihood: float
    null_log_likelihood: float


def fit_logit(df: DataFrame, predictors: Sequence[str] = PREDICTORS, label: str = LABEL) -> LogitFit:
    """Maximum likelihood over the complete rows, fitted on scaled predictors and put back on their own scale."""
    rows = complete_rows(df, predictors, label)
    scale = population_scale(rows, predictors)
    sizes = rows.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    ((beta, information, likelihood),) = newton_fits(rows, [scale.z(x) for x in predictors], label)
    means, sds = (np.array([d[x] for x in predictors]) for d in (scale.means, scale.sds))
    back = np.diag(np.concatenate([[1.0], 1 / sds]))
    back[0, 1:] = -means / sds
    covariance = back @ np.linalg.inv(information) @ back.T
    n = sum(sizes)
    return LogitFit(
        tuple(predictors),
        n,
        [float(b) for b in back @ beta],
        [float(e) for e in np.sqrt(np.diag(covariance))],
        likelihood,
        sum(c * math.log(c / n) for c in sizes if c),
    )


def odds_table(spark: SparkSession, fit: LogitFit) -> DataFrame:
    """Per term: B, error, Wald chi-square, p, odds ratio with its 95 % interval and mark."""
    reach = tails.normal_critical()
    rows = []
    for term, b, se in zip([INTERCEPT, *fit.predictors], fit.coefficients, fit.standard_errors):
        p = tails.normal_two_sided(b / se)
        rows.append(
            (term, b, se, (b / se) ** 2, p, math.exp(b), math.exp(b - reach * se), math.exp(b + reach * se), mark_of(p))
        )
    return spark.createDataFrame(
        rows,
        "term string, b double, std_error double, wald double, p double, odds_ratio double, lower double, "
        "upper double, mark string",
    )


def odds_changes(odds: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Terms other than the intercept with p < alpha: direction and percent change of the odds per unit."""
    up = F.col("odds_ratio") > 1
    return odds.filter((F.col("p") < alpha) & (F.col("term") != INTERCEPT)).select(
        "term",
        "odds_ratio",
        F.when(up, "increase").otherwise("decrease").alias("direction"),
        (F.abs(F.col("odds_ratio") - 1) * 100).alias("change_pct"),
    )


def logit_fit_table(spark: SparkSession, fit: LogitFit) -> DataFrame:
    """McFadden's R squared, likelihoods, likelihood-ratio test and information criteria.

    ``converged`` is always true: a fit that did not settle raises ``NotConverged`` instead.
    """
    ll, null, k = fit.log_likelihood, fit.null_log_likelihood, len(fit.predictors)
    ratio = -2 * (null - ll)
    row = (
        fit.n, 1 - ll / null, ll, null, ratio, tails.chi2_tail(ratio, k), -2 * ll + 2 * (k + 1),
        -2 * ll + math.log(fit.n) * (k + 1), True,
    )
    return spark.createDataFrame(
        [row],
        "n bigint, mcfadden_r2 double, log_likelihood double, null_log_likelihood double, lr_chi2 double, lr_p double, "
        "aic double, bic double, converged boolean",
    )


# --- classifier ------------------------------------------------------------------------------------------------


def class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weight of each class, n / (classes * class size)."""
    sizes = train.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    classes = sizes.agg(F.count(F.lit(1))).scalar()
    return sizes.select(label, "n", (total / (classes * F.col("n"))).alias("weight"))


@dataclass(frozen=True)
class Classifier:
    scale: Scale
    predictors: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]

    def score(self) -> Column:
        """Probability of class 1, as an ordinary expression."""
        terms = [F.lit(b) * self.scale.z(x) for b, x in zip(self.coefficients, self.predictors)]
        return 1 / (1 + F.exp(-reduce(lambda total, term: total + term, terms, F.lit(self.intercept))))


def _balanced(sizes: dict[int, int], label: str) -> Column:
    """Weight column n / (classes * class size)."""
    total = sum(sizes.values())
    return reduce(lambda chain, c: chain.when(F.col(label) == c, F.lit(total / (len(sizes) * sizes[c]))), sizes, F)


def fit_classifier(
    train: DataFrame, scale: Scale, predictors: Sequence[str] = PREDICTORS, label: str = LABEL
) -> Classifier:
    """Penalised logistic classifier on scaled predictors with balanced class weights.

    Maximises the weighted log-likelihood less half the squared coefficients over C.
    """
    sizes = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    ((beta, _, _),) = newton_fits(
        train, [scale.z(x) for x in predictors], label, weight=F.array(_balanced(sizes, label)), penalty=1 / INVERSE_PENALTY
    )
    return Classifier(scale, tuple(predictors), float(beta[0]), tuple(float(b) for b in beta[1:]))


def score_rows(rows: DataFrame, classifier: Classifier) -> DataFrame:
    """Rows with ``score`` and the predicted class ``predicted``."""
    return rows.withColumn("score", classifier.score()).withColumn(
        "predicted", (F.col("score") > THRESHOLD).cast("int")
    )


# --- evaluation ------------------------------------------------------------------------------------------------


def confusion(scored: DataFrame, label: str = LABEL) -> DataFrame:
    """Counts of (actual, predicted) for both classes, zeros included."""
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    counts = scored.agg(
        *[F.count_if((F.col(label) == a) & (F.col("predicted") == p)).alias(f"c{a}{p}") for a, p in cells]
    )
    rows = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{a}{p}").alias("n")) for a, p in cells]
    return counts.select(F.inline(F.array(*rows)))


def class_report(confused: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, and macro and weighted means."""
    cell = {
        (a, p): F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n"))).alias(f"c{a}{p}")
        for a in (0, 1)
        for p in (0, 1)
    }
    one = confused.agg(*cell.values())

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    def of_class(c: int) -> dict[str, Column]:
        hit, false_alarm, miss = F.col(f"c{c}{c}"), F.col(f"c{1 - c}{c}"), F.col(f"c{c}{1 - c}")
        return {
            "precision": ratio(hit, hit + false_alarm),
            "recall": ratio(hit, hit + miss),
            "f1": ratio(2 * hit, 2 * hit + false_alarm + miss),
            "support": hit + miss,
        }

    zero, first = of_class(0), of_class(1)
    total = zero["support"] + first["support"]
    accuracy = (F.col("c00") + F.col("c11")) / total

    def row(name: str, values: dict[str, Column]) -> Column:
        return F.struct(F.lit(name).alias("class"), *[v.alias(k) for k, v in values.items()])

    def mean(weight0: Column, weight1: Column) -> dict[str, Column]:
        shares = {k: zero[k] * weight0 + first[k] * weight1 for k in ("precision", "recall", "f1")}
        return {**shares, "support": total}

    half = F.lit(0.5)
    nothing = F.lit(None).cast("double")
    return one.select(
        F.inline(
            F.array(
                row("0", zero),
                row("1", first),
                row("accuracy", {"precision": nothing, "recall": nothing, "f1": accuracy, "support": total}),
                row("macro avg", mean(half, half)),
                row("weighted avg", mean(zero["support"] / total, first["support"] / total)),
            )
        )
    )


def curve_counts(
    scored: DataFrame, score: str = "score", label: str = LABEL, keys: Sequence[str] = (), following: bool = False
) -> DataFrame:
    """Positives and negatives at each distinct score and above it, from the highest score down; with ``following`` also those at the
    next lower score (``pos_next``, ``neg_next``, null for the last)."""
    keys = list(keys)
    known = scored.dropna(subset=[score, label]).withColumn("_down", -F.col(score).cast("double"))
    limits = numeric_limits(known, ["_down"])["_down"]
    counts = known.groupBy(*keys, "_down").agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg")
    )
    totals = running_totals(counts, keys, "_down", ["pos", "neg"], range_of(F.col("_down"), limits), following)
    return totals.withColumn("threshold", -F.col("_down")).drop("_down", "_down_next")


def _here(name: str) -> Column:
    return F.col(f"{name}_before") + F.col(name)


def roc_curve(counts: DataFrame) -> DataFrame:
    """A point per distinct score, and the origin with no threshold."""
    points = counts.select(
        "threshold",
        (_here("neg") / F.col("neg_all")).alias("fpr"),
        (_here("pos") / F.col("pos_all")).alias("tpr"),
    )
    origin = counts.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def roc_polyline(counts: DataFrame, straight: bool = False) -> DataFrame:
    """The curve without points that no line needs, from counts with the ``following`` ones. Areas and the best threshold stay.

    A point goes if the step to the next point repeats the step to it, so that the runs of single rows become one line; the highest and
    the lowest score stay. With ``straight`` every point goes that lies on the line between its neighbours, whatever the length
    of the steps, and only the lowest score is sure to stay.
    """
    last = F.col("pos_next").isNull()
    if straight:
        wide = {c: F.col(c).cast("decimal(19,0)") for c in ("pos", "neg", "pos_next", "neg_next")}
        corner = last | (wide["pos"] * wide["neg_next"] != wide["neg"] * wide["pos_next"])
    else:
        first = F.col("pos_before") + F.col("neg_before") == 0
        corner = first | last | (F.col("pos") != F.col("pos_next")) | (F.col("neg") != F.col("neg_next"))
    return roc_curve(counts.filter(corner))


def roc_auc(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by trapezoids."""
    step = F.col("neg") * (F.col("pos_before") + F.col("pos") / 2)
    return counts.groupBy(*keys).agg(
        (F.sum(step) / (F.max("pos_all").cast("double") * F.max("neg_all"))).alias("roc_auc")
    )


def youden(counts: DataFrame) -> DataFrame:
    """The threshold with the largest sensitivity + specificity - 1; the highest one on a tie."""
    lift = _here("pos").cast("double") * F.col("neg_all") - _here("neg").cast("double") * F.col("pos_all")
    best = F.max_by(
        F.struct(
            "threshold",
            (_here("pos") / F.col("pos_all")).alias("sensitivity"),
            (1 - _here("neg") / F.col("neg_all")).alias("specificity"),
        ),
        F.struct(lift, "threshold"),
    )
    return counts.agg(best.alias("best")).select("best.*")


def pr_curve(counts: DataFrame) -> DataFrame:
    """Precision and recall at each distinct score, and the end point (1, 0) with no threshold."""
    points = counts.select(
        "threshold",
        (_here("pos") / (_here("pos") + _here("neg"))).alias("precision"),
        (_here("pos") / F.col("pos_all")).alias("recall"),
    )
    end = counts.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return end.unionByName(points)


def pr_auc(counts: DataFrame) -> DataFrame:
    """Area under the precision-recall curve by trapezoids over recall."""
    precision = _here("pos") / (_here("pos") + _here("neg"))
    above = F.coalesce(
        F.try_divide("pos_before", F.col("pos_before") + F.col("neg_before")), F.lit(1.0)
    )
    return counts.agg(F.sum(F.col("pos") / F.col("pos_all") * (precision + above) / 2).alias("pr_auc"))


def fold_auc(
    df: DataFrame, predictors: Sequence[str] = PREDICTORS, label: str = LABEL, folds: int = FOLDS
) -> DataFrame:
    """ROC-AUC of each fold, scored by a classifier trained on the other folds.

    The predictors are scaled on all rows first. All classifiers are fitted together, and since they are a few numbers
    each, all folds are scored and measured in one pass.
    """
    rows = complete_rows(df, predictors, label)
    scale = population_scale(rows, predictors)
    folded = keep(stratified_folds(rows.select("customer_unique_id", label, *predictors), label, folds=folds))
    sizes = {(r["fold"], r[label]): r["n"] for r in folded.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted({c for _, c in sizes})
    train_sizes = [{c: sum(n for (f, k), n in sizes.items() if f != i and k == c) for c in classes} for i in range(folds)]
    fits = newton_fits(
        folded,
        [scale.z(x) for x in predictors],
        label,
        models=folds,
        model=F.array_remove(F.array(*[F.lit(i) for i in range(folds)]), F.col("fold")),
        weight=F.array(*[_balanced(s, label) for s in train_sizes]),
        penalty=1 / INVERSE_PENALTY,
    )
    models = [Classifier(scale, tuple(predictors), float(b[0]), tuple(map(float, b[1:]))) for b, _, _ in fits]
    score = reduce(lambda chain, i: chain.when(F.col("fold") == i, models[i].score()), range(folds), F)
    return roc_auc(curve_counts(folded.withColumn("score", score), "score", label, ["fold"]), ["fold"])


def cv_auc(per_fold: DataFrame) -> DataFrame:
    """Mean of the folds' areas and twice their population deviation."""
    return per_fold.agg(
        F.avg("roc_auc").alias("mean_auc"), (2 * F.stddev_pop("roc_auc")).alias("two_sd"), F.count(F.lit(1)).alias("folds")
    )
