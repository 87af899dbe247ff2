"""Registered queries against their SQL on the smallest data set.

A cross-section that covers every module; ``python -m tests.compare <folder>`` runs all of them.
"""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from cohortry.plans.catalog import star_queries
from cohortry.plans.oracle import star_oracle
from tests.compare import connect, difference

BASE = "/root/testdata/sf0.001"

CHECKED = [
    "row_counts", "order_payment", "repeat_share", "segment_compare", "group_describe_category", "interaction_means",
    "crosstab_repeat_payment", "report_long", "fm_segments", "segment_freq", "popular_categories", "recommendations",
    "pearson_value", "corr_compare", "anova_summary", "levene_state", "tukey_pairs_payment", "two_way_anova", "kruskal_state",
    "chi2_repeat_payment", "vif", "ols_coefficients", "ols_fit", "ols_residual_stats", "durbin_watson", "ols_holdout", "logit_fit",
    "holdout_split", "stratified_folds", "class_report", "roc_curve", "youden", "cv_auc", "tree_rules", "tree_report",
    "box_stats_payment", "residual_hist", "qq_fit", "residual_scatter",
]

pytestmark = pytest.mark.skipif(not Path(BASE).exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, name):
    assert difference(contract.queries()[name](spark, BASE), con, contract.oracle_sql()[name]) is None


def test_contract(spark):
    df = contract.entry(spark)
    assert len(df.columns) == 13 and df.count() > 0
    assert set(star_oracle()) == set(star_queries()) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
