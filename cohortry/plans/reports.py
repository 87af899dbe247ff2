"""The six analyses as sets of result tables, and a command that writes them.

    spark-submit cohortry/plans/reports.py --input <folder> --format parquet --output <folder> [--only anova …]

The input folder holds one CSV file or parquet directory per table (``orders``, ``customers``, ``order_items``,
``order_reviews``, ``order_payments``, ``products``, ``translation``); for the format ``table`` it is a database name.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortry.operators import anova, charts, classify, correlation, regression, segments, splits, summaries, tree
from cohortry.plans.workspace import Workspace
from cohortry.sources.sinks import publish_results, write_results
from cohortry.sources.tables import SCHEMAS, load

VALUE = "avg_order_value"
KEY = "customer_unique_id"


def comparison_report(ws: Workspace) -> dict[str, DataFrame]:
    """Repeat customers against single ones, and the tree that tells them apart."""
    spark = ws.features.sparkSession
    scored = tree.predict_tree(ws.tree_split.filter("is_test = 1"), ws.tree)
    confused = classify.confusion(scored)
    importance = tree.importance_table(spark, ws.tree)
    return {
        "repeat_share": summaries.repeat_share(ws.features),
        "segment_compare": summaries.segment_compare(ws.features),
        "tree_rows": classify.row_usage(ws.features),
        "tree_rules": tree.rule_table(spark, ws.tree),
        "tree_importance": importance,
        "tree_top_features": importance.filter("rank <= 3"),
        "tree_confusion": confused,
        "tree_class_report": classify.class_report(confused),
    }


def correlation_report(ws: Workspace) -> dict[str, DataFrame]:
    f = ws.features
    return {
        "pearson": correlation.pearson_matrix(f),
        "with_frequency": correlation.pearson_target(f, "frequency"),
        "with_order_value": correlation.pearson_target(f, VALUE),
        "spearman": correlation.spearman_matrix(f),
        "pearson_spearman": correlation.compare_methods(f),
        "scatter": charts.sample_rows(f, ["frequency", "avg_review_score", "avg_delay_days", "avg_freight_ratio", VALUE], KEY),
    }


def anova_report(ws: Workspace) -> dict[str, DataFrame]:
    """The three one-way analyses with their groups, pairs and boxes; the two-way analysis; the rank tests."""
    f = ws.features
    out = {"summary": anova.anova_summary(f)}
    for name, factor in (("state", "state"), ("category", "favorite_category"), ("payment", "preferred_payment")):
        rows = anova.factor_rows(f, factor)
        out[f"{name}_groups"] = summaries.describe(rows, [factor], VALUE).orderBy("mean", ascending=False)
        out[f"{name}_test"] = anova.one_way(rows, factor)
        out[f"{name}_boxes"] = charts.box_stats(rows, [factor], VALUE)
    states, categories = anova.factor_rows(f, "state"), anova.factor_rows(f, "favorite_category")
    pairs = anova.tukey_if_significant(states, "state")
    return {
        **out,
        "state_levene": anova.levene(states, "state"),
        "state_rejected_pairs": anova.rejected_pairs(pairs),
        "payment_pairs": anova.tukey_if_significant(f, "preferred_payment"),
        "two_way_groups": summaries.two_way_describe(f),
        "two_way": anova.two_way(f, "is_repeat", "preferred_payment"),
        "interaction_means": summaries.interaction_means(f),
        "state_kruskal": anova.kruskal(states, "state"),
        "category_kruskal": anova.kruskal(categories, "favorite_category"),
    }


def linear_report(ws: Workspace) -> dict[str, DataFrame]:
    spark = ws.features.sparkSession
    coefficients = regression.coefficient_table(spark, ws.linear)
    return {
        "vif": regression.vif_table(spark, ws.linear),
        "coefficients": coefficients,
        "significant": regression.significant_terms(coefficients),
        "coefficient_arms": charts.coefficient_arms(coefficients, "b"),
        "fit": regression.fit_table(spark, ws.linear),
        "residuals": regression.residual_statistics(spark, ws.residuals),
        "durbin_watson": regression.durbin_watson(ws.residuals),
        "holdout": regression.holdout_metrics(splits.holdout(regression.complete_rows(ws.features))),
        "residual_histogram": regression.residual_histogram(ws.residuals),
        "residual_box": charts.box_stats(ws.residuals, [], "residual"),
        "residual_scatter": charts.sample_rows(ws.residuals, ["fitted", "residual"], KEY),
        "qq_points": regression.qq_points(ws.residuals),
        "qq_line": regression.qq_fit(regression.qq_points(ws.residuals)),
    }


def logistic_report(ws: Workspace) -> dict[str, DataFrame]:
    spark = ws.features.sparkSession
    odds = classify.odds_table(spark, ws.logit)
    confused, counts = classify.confusion(ws.scored), classify.curve_counts(ws.scored, following=True)
    return {
        "rows": classify.row_usage(ws.features),
        "odds": odds,
        "odds_changes": classify.odds_changes(odds),
        "odds_arms": charts.coefficient_arms(odds, "odds_ratio"),
        "fit": classify.logit_fit_table(spark, ws.logit),
        "class_weights": classify.class_weights(ws.class_split.filter("is_test = 0")),
        "confusion": confused,
        "class_report": classify.class_report(confused),
        "cross_validation": classify.cv_auc(ws.fold_auc),
        "roc_curve": classify.roc_curve(counts),
        "roc_polyline": classify.roc_polyline(counts),
        "roc_auc": classify.roc_auc(counts),
        "best_threshold": classify.youden(counts),
        "pr_curve": classify.pr_curve(counts),
        "pr_auc": classify.pr_auc(counts),
        "association": anova.chi2_independence(ws.features),
        "contingency": anova.contingency(ws.features),
        "crosstab": summaries.crosstab(ws.features),
    }


def segment_report(ws: Workspace) -> dict[str, DataFrame]:
    """Segments, the first target customers, their favourite categories and the products to recommend."""
    popular = segments.popular_categories(ws.tables, ws.segmented)
    return {
        "segments": segments.segment_frequencies(ws.segmented),
        "target_customers": segments.top_targets(ws.segmented),
        "popular_categories": segments.leading_categories(popular),
        "recommendations": segments.recommendations(ws.tables, popular),
    }


REPORTS: dict[str, Callable[[Workspace], dict[str, DataFrame]]] = {
    "comparison": comparison_report,
    "correlation": correlation_report,
    "anova": anova_report,
    "linear": linear_report,
    "logistic": logistic_report,
    "segments": segment_report,
}


def write_reports(ws: Workspace, folder: str, only: list[str] | None = None, fmt: str = "parquet") -> dict[str, str]:
    """Write the chosen analyses, a folder each with a directory per table. Returns the paths by ``analysis/table``."""
    paths = {}
    for name in only or REPORTS:
        written = write_results(REPORTS[name](ws), f"{folder.rstrip('/')}/{name}", fmt)
        paths |= {f"{name}/{table}": path for table, path in written.items()}
    return paths


def publish_reports(ws: Workspace, folder: str, only: list[str] | None = None, fmt: str = "parquet") -> dict[str, str]:
    """Publish the chosen analyses as one set: readers see the tables of one run, never some of it."""
    tables = {f"{name}/{table}": df for name in only or REPORTS for table, df in REPORTS[name](ws).items()}
    return publish_results(tables, folder, fmt)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Write the customer analyses as result tables.")
    parser.add_argument("--input", required=True)
    parser.add_argument("--format", choices=["csv", "parquet", "table"], default="csv")
    parser.add_argument("--output", required=True)
    parser.add_argument("--output-format", choices=["csv", "parquet"], default="parquet")
    parser.add_argument("--publish", action="store_true", help="all tables as one set, switched at the end")
    parser.add_argument("--only", nargs="*", choices=sorted(REPORTS))
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("cohortry-reports").getOrCreate()
    names = {"csv": "{0}/{1}.csv", "parquet": "{0}/{1}", "table": "{0}.{1}"}[given.format]
    tables = load(spark, {n: names.format(given.input.rstrip("/"), n) for n in SCHEMAS}, given.format)
    write = publish_reports if given.publish else write_reports
    write(Workspace(tables), given.output, given.only, given.output_format)


if __name__ == "__main__":
    main()
