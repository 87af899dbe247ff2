"""Times the headline queries once each and prints one JSON line.

    BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default: all)

``features_build`` reads the base tables; the queries after it share its persisted result, as a session of analyses
would. Every query is run to the end; its result is written to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cohortry.plans.catalog import star_queries  # noqa: E402
from cohortry.plans.workspace import star_workspace  # noqa: E402
from cohortry.session import local_session  # noqa: E402

HEADLINE = [
    "order_summary", "order_payment", "order_top_category", "customer_features", "segment_compare", "group_describe_state",
    "crosstab_repeat_payment", "fm_metrics", "fm_segments", "popular_categories", "recommendations", "pearson_matrix",
    "spearman_matrix", "anova_summary", "levene_state", "kruskal_category", "two_way_anova", "chi2_repeat_payment",
    "ols_coefficients", "durbin_watson", "qq_fit", "ols_holdout", "logit_odds", "class_report", "roc_auc", "cv_auc", "tree_rules",
    "box_stats_payment",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = local_session(cores, "cohortry-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors

    def timed(action) -> float:
        start = time.perf_counter()
        action()
        return round(time.perf_counter() - start, 3)

    times = {"features_build": timed(lambda: star_workspace(spark, base).features.count())}
    queries = star_queries()
    for name in HEADLINE:
        times[name] = timed(lambda: queries[name](spark, base).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(base).name.removeprefix("sf"),
                "cpus": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
