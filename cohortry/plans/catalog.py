"""Every registered query: a name and a function from a workspace to a result table.

Doubles are rounded for comparison with the same query in SQL; the operators themselves do not round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import anova, charts, classify, correlation, features, ranks, regression, segments, splits
from cohortry.operators import summaries, tree
from cohortry.plans.workspace import Workspace, star_workspace

VALUE = "avg_order_value"
FIXTURE_MIN_RATING = 3.3
FIXTURE_ALPHA = 0.9  # on random test data no term is significant at 0.05
FIXTURE_GATE = 1.0  # opens the gate whatever the test data
FIXTURE_CLOSED = 0.0  # keeps the gate closed whatever the test data
FIXTURE_PAIRS = 3  # fewer than are rejected at the test data's level
FIXTURE_SAMPLE = 50  # below the number of rows of the smallest test data
KEY = "customer_unique_id"


def rounded(df: DataFrame, default: int | None = None, **places: int) -> DataFrame:
    """Round double columns: the named ones to their places, the others to ``default`` places if given."""
    out = []
    for name, kind in df.dtypes:
        digits = places.get(name, default if kind == "double" else None)
        out.append(F.col(f"`{name}`") if digits is None else F.round(F.col(f"`{name}`"), digits).alias(name))
    return df.select(*out)


HALF_STEP = 5e-10


def settled(df: DataFrame, default: int, **places: int) -> DataFrame:
    """Round columns kept on the feature grid, from half a grid step above, so that no grid value is a rounding tie."""
    lifted = [(F.col(n) + HALF_STEP).alias(n) if kind == "double" else F.col(n) for n, kind in df.dtypes]
    return rounded(df.select(*lifted), default, **places)


MONEY = {"avg_order_value": 4, "total_spent": 4}


def _spark(ws: Workspace) -> SparkSession:
    return ws.features.sparkSession


def _popular(ws: Workspace) -> DataFrame:
    return segments.popular_categories(ws.tables, ws.segmented)


def _describe(ws: Workspace, factor: str) -> DataFrame:
    return rounded(summaries.describe(ws.factor_rows(factor), [factor], VALUE), 4)


def _anova(ws: Workspace, factor: str) -> DataFrame:
    return rounded(anova.anova_of(ws.features, factor), 6, ss_between=0, ss_within=0)


def _kruskal(ws: Workspace, factor: str) -> DataFrame:
    return rounded(anova.kruskal(ws.factor_rows(factor), factor), 6)


def _levene(ws: Workspace, factor: str) -> DataFrame:
    return rounded(anova.levene(ws.factor_rows(factor), factor), 6)


def _factor(ws: Workspace, factor: str) -> DataFrame:
    return ws.factor_rows(factor)


def _tukey_rounded(pairs: DataFrame) -> DataFrame:
    return rounded(pairs, mean_diff=3, std_error=3, q=6, p_adj=5, lower=1, upper=1)


def _tukey(ws: Workspace, factor: str) -> DataFrame:
    return _tukey_rounded(anova.tukey(_factor(ws, factor), factor))


def _box(ws: Workspace, factor: str) -> DataFrame:
    return settled(charts.box_stats(ws.factor_rows(factor), [factor], VALUE), 4)


def _coefficients(ws: Workspace) -> DataFrame:
    return regression.coefficient_table(_spark(ws), ws.linear)


def _odds(ws: Workspace) -> DataFrame:
    return classify.odds_table(_spark(ws), ws.logit)


def _curve(ws: Workspace) -> DataFrame:
    return classify.curve_counts(ws.scored)


def _column_curve(ws: Workspace, following: bool = False) -> DataFrame:
    """A curve over a feature with many ties, in place of a model's score."""
    return classify.curve_counts(ws.features, "avg_payment_installments", following=following)


def _sampled(ws: Workspace, percent: float | dict) -> DataFrame:
    return splits.sampled_holdout(ws.features, label=classify.LABEL, percent=percent)


def _tree_scored(ws: Workspace) -> DataFrame:
    return tree.predict_tree(ws.tree_split.filter("is_test = 1"), ws.tree)


def _report(ws: Workspace) -> DataFrame:
    return summaries.report(
        {
            "customers": summaries.repeat_share(ws.features),
            "comparison": summaries.segment_compare(ws.features),
            "anova": anova.anova_summary(ws.features),
            "association": anova.chi2_independence(ws.features),
            "segments": segments.segment_frequencies(ws.segmented),
        }
    )


CATALOG: dict[str, Callable[[Workspace], DataFrame]] = {
    # base tables and customer features
    "row_counts": lambda ws: summaries.row_counts(ws.tables),
    "order_summary": lambda ws: rounded(features.order_summary(ws.tables.order_items), 6),
    "order_review": lambda ws: rounded(features.order_review(ws.tables.order_reviews), 6),
    "order_payment": lambda ws: rounded(features.order_payment(ws.tables.order_payments), 6),
    "order_top_category": lambda ws: features.order_top_category(ws.tables),
    "customer_features": lambda ws: settled(ws.features, 6, **MONEY),
    "catalog_features": lambda ws: settled(features.customer_features(ws.keyed), 6, **MONEY),
    "csv_features": lambda ws: settled(
        features.customer_features(ws.from_csv).withColumn(KEY, F.col(KEY).cast("long")), 6, **MONEY
    ),
    "csv_row_counts": lambda ws: summaries.row_counts(ws.from_csv),
    "feature_preview": lambda ws: settled(summaries.preview(ws.features, KEY), 6, **MONEY),
    # summaries
    "repeat_share": lambda ws: rounded(summaries.repeat_share(ws.features), 6),
    "segment_compare": lambda ws: rounded(summaries.segment_compare(ws.features), 6),
    "top_states": lambda ws: summaries.top_levels(ws.features, "state"),
    "group_describe_state": lambda ws: _describe(ws, "state"),
    "group_describe_category": lambda ws: _describe(ws, "favorite_category"),
    "group_describe_payment": lambda ws: _describe(ws, "preferred_payment"),
    "two_way_describe": lambda ws: rounded(summaries.two_way_describe(ws.features), 4),
    "interaction_means": lambda ws: rounded(summaries.interaction_means(ws.features), 4),
    "crosstab_repeat_payment": lambda ws: summaries.crosstab(ws.features),
    "report_long": lambda ws: rounded(_report(ws), 4),
    # frequency x monetary segments and recommendations
    "fm_metrics": lambda ws: rounded(ws.fm, 6),
    "fm_medians": lambda ws: rounded(
        ranks.exact_quantiles(ws.fm, [], "monetary", {"median_monetary": 0.5})
        .select("median_monetary", ranks.exact_quantiles(ws.fm, [], "frequency", {"m": 0.5}).select("m").scalar().alias("median_frequency")),
        6,
    ),
    "fm_segments": lambda ws: rounded(ws.segmented, 6),
    "segment_freq": lambda ws: rounded(segments.segment_frequencies(ws.segmented), 4),
    "target_top20": lambda ws: rounded(segments.top_targets(ws.segmented), 6),
    "popular_categories": _popular,
    "popular_top10": lambda ws: segments.leading_categories(_popular(ws)),
    "rated_products": lambda ws: rounded(
        segments.product_ratings(ws.tables, segments.leading_categories(_popular(ws)), FIXTURE_MIN_RATING), 6
    ),
    "recommendations": lambda ws: rounded(segments.recommendations(ws.tables, _popular(ws), FIXTURE_MIN_RATING), 6),
    "recommendations_delivered": lambda ws: rounded(
        segments.recommendations(ws.tables, _popular(ws), 3.0, 3, delivered_only=True), 6
    ),
    # correlation
    "pearson_matrix": lambda ws: rounded(correlation.pearson_matrix(ws.features), 6),
    "pearson_frequency": lambda ws: rounded(correlation.pearson_target(ws.features, "frequency"), 6),
    "pearson_value": lambda ws: rounded(correlation.pearson_target(ws.features, VALUE), 6),
    "spearman_matrix": lambda ws: rounded(correlation.spearman_matrix(ws.features), 6),
    "corr_compare": lambda ws: rounded(correlation.compare_methods(ws.features), 6),
    # group comparisons
    "anova_state": lambda ws: _anova(ws, "state"),
    "anova_category": lambda ws: _anova(ws, "favorite_category"),
    "anova_payment": lambda ws: _anova(ws, "preferred_payment"),
    "anova_summary": lambda ws: rounded(anova.anova_summary(ws.features), 6),
    "levene_state": lambda ws: _levene(ws, "state"),
    "levene_payment": lambda ws: _levene(ws, "preferred_payment"),
    "tukey_stats_state": lambda ws: _tukey(ws, "state").drop("lower", "upper"),
    "tukey_stats_payment": lambda ws: _tukey(ws, "preferred_payment").drop("lower", "upper"),
    "tukey_pairs_state": lambda ws: _tukey(ws, "state"),
    "tukey_pairs_payment": lambda ws: _tukey(ws, "preferred_payment"),
    "tukey_gated_state": lambda ws: _tukey_rounded(anova.tukey_if_significant(_factor(ws, "state"), "state", alpha=FIXTURE_GATE)),
    "tukey_gated_payment": lambda ws: _tukey_rounded(anova.tukey_if_significant(_factor(ws, "preferred_payment"), "preferred_payment", alpha=FIXTURE_GATE)),
    "tukey_closed_state": lambda ws: _tukey_rounded(anova.tukey_if_significant(_factor(ws, "state"), "state", alpha=FIXTURE_CLOSED)),
    "tukey_rejected_state": lambda ws: _tukey_rounded(
        anova.rejected_pairs(anova.tukey(_factor(ws, "state"), "state"), FIXTURE_PAIRS, FIXTURE_ALPHA)
    ),
    "two_way_anova": lambda ws: rounded(
        anova.two_way(ws.features, "is_repeat", "preferred_payment"), 6, sum_sq=-3
    ),
    "kruskal_state": lambda ws: _kruskal(ws, "state"),
    "kruskal_category": lambda ws: _kruskal(ws, "favorite_category"),
    "contingency": lambda ws: rounded(anova.contingency(ws.features), 6),
    "chi2_repeat_payment": lambda ws: rounded(anova.chi2_independence(ws.features), 6),
    # linear regression
    "vif": lambda ws: rounded(regression.vif_table(_spark(ws), ws.linear), 6),
    "ols_coefficients": lambda ws: rounded(
        _coefficients(ws), 5, b=3, std_error=3, lower=2, upper=2
    ),
    "ols_significant": lambda ws: rounded(regression.significant_terms(_coefficients(ws)), 3),
    "ols_fit": lambda ws: rounded(
        regression.fit_table(_spark(ws), ws.linear).drop("condition_number"), 6, f=4, log_likelihood=4, aic=4, bic=4
    ),
    "ols_condition": lambda ws: rounded(regression.fit_table(_spark(ws), ws.linear).select("n", "condition_number"), 1),
    "ols_coefficient_arms": lambda ws: rounded(charts.coefficient_arms(_coefficients(ws), "b"), 1, b=3),
    "ols_residual_stats": lambda ws: rounded(
        regression.residual_statistics(_spark(ws), ws.residuals)
        .withColumn("abs_mean", F.abs(F.round("mean", 3)))
        .drop("mean"),
        5,
        sd=3,
        omnibus=4,
        jarque_bera=3,
    ),
    "durbin_watson": lambda ws: rounded(regression.durbin_watson(ws.residuals), 6),
    "ols_holdout": lambda ws: rounded(
        regression.holdout_metrics(splits.holdout(regression.complete_rows(ws.features))), 6, rmse=3, mae=3
    ),
    # logistic regression and evaluation
    "logit_odds": lambda ws: rounded(
        _odds(ws), 6, wald=5, odds_ratio=5, lower=5, upper=3
    ),
    "logit_changes": lambda ws: rounded(classify.odds_changes(_odds(ws), FIXTURE_ALPHA), 5),
    "logit_fit": lambda ws: rounded(classify.logit_fit_table(_spark(ws), ws.logit), 5),
    "logit_odds_arms": lambda ws: rounded(charts.coefficient_arms(_odds(ws), "odds_ratio"), 5, arm_high=3),
    "model_rows": lambda ws: rounded(classify.row_usage(ws.features), 6),
    "holdout_split": lambda ws: splits.holdout(ws.features, label="is_repeat").select(KEY, "is_repeat", "is_test"),
    "plain_split": lambda ws: splits.holdout(ws.features).select(KEY, "is_test"),
    "sampled_split": lambda ws: _sampled(ws, {0: 30, 1: 50}).select(KEY, "is_repeat", "is_test"),
    "sampled_shares": lambda ws: rounded(splits.sample_shares(_sampled(ws, splits.TEST_SHARE_PERCENT), classify.LABEL), 6),
    "stratified_folds": lambda ws: splits.stratified_folds(ws.features, "is_repeat").select(KEY, "is_repeat", "fold"),
    "class_weights": lambda ws: rounded(classify.class_weights(ws.class_split.filter("is_test = 0")), 6),
    "classifier_scores": lambda ws: rounded(ws.scored.select(KEY, "score", "predicted"), 6),
    "confusion": lambda ws: classify.confusion(ws.scored),
    "class_report": lambda ws: rounded(classify.class_report(classify.confusion(ws.scored)), 6),
    "roc_curve": lambda ws: rounded(classify.roc_curve(_curve(ws)), 6),
    "roc_polyline": lambda ws: rounded(classify.roc_polyline(classify.curve_counts(ws.scored, following=True)), 6),
    "roc_polyline_straight": lambda ws: rounded(classify.roc_polyline(classify.curve_counts(ws.scored, following=True), straight=True), 6),
    "roc_polyline_tied": lambda ws: rounded(classify.roc_polyline(_column_curve(ws, following=True), straight=True), 6),
    "roc_auc": lambda ws: rounded(classify.roc_auc(_curve(ws)), 6),
    "youden": lambda ws: rounded(classify.youden(_curve(ws)), 6),
    "pr_curve": lambda ws: rounded(classify.pr_curve(_curve(ws)), 6),
    "pr_auc": lambda ws: rounded(classify.pr_auc(_curve(ws)), 6),
    "roc_curve_tied": lambda ws: rounded(classify.roc_curve(_column_curve(ws)), 6),
    "pr_auc_tied": lambda ws: rounded(classify.pr_auc(_column_curve(ws)), 6),
    "fold_auc": lambda ws: rounded(ws.fold_auc, 6),
    "cv_auc": lambda ws: rounded(classify.cv_auc(ws.fold_auc), 6),
    # decision tree
    "tree_rules": lambda ws: rounded(tree.rule_table(_spark(ws), ws.tree), 6),
    "tree_importance": lambda ws: rounded(tree.importance_table(_spark(ws), ws.tree), 6),
    "tree_confusion": lambda ws: classify.confusion(_tree_scored(ws)),
    "tree_report": lambda ws: rounded(classify.class_report(classify.confusion(_tree_scored(ws))), 6),
    # chart data
    "box_stats_state": lambda ws: _box(ws, "state"),
    "box_stats_category": lambda ws: _box(ws, "favorite_category"),
    "box_stats_payment": lambda ws: _box(ws, "preferred_payment"),
    "box_stats_residual": lambda ws: rounded(charts.box_stats(ws.residuals, [], "residual"), 3),
    "residual_hist": lambda ws: rounded(regression.residual_histogram(ws.residuals), 2),
    "qq_points": lambda ws: rounded(regression.qq_points(ws.residuals), 6, residual=2),
    "qq_fit": lambda ws: rounded(regression.qq_fit(regression.qq_points(ws.residuals)), 6, slope=3, intercept=3),
    "scatter_sample": lambda ws: settled(
        charts.sample_rows(
            ws.features,
            ["frequency", "avg_review_score", "avg_delay_days", "avg_freight_ratio", VALUE],
            KEY,
            FIXTURE_SAMPLE,
        ),
        6,
        **MONEY,
    ),
    "residual_scatter": lambda ws: rounded(charts.sample_rows(ws.residuals, ["fitted", "residual"], KEY, FIXTURE_SAMPLE), 2),
}


def _runner(build: Callable[[Workspace], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, base: build(star_workspace(spark, base))


def star_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The catalogue over a star-schema folder."""
    return {name: _runner(build) for name, build in CATALOG.items()}
