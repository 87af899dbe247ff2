"""Inputs that many analyses share: computed once per session and location, then read by all of them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from cohortry.operators import anova, classify, features, regression, segments, splits, tree
from cohortry.sources.keyed import load_keyed, save_keyed
from cohortry.sources.scratch import fresh_path, keep
from cohortry.sources.star import star_tables
from cohortry.sources.tables import SCHEMAS, Tables, load


CSV_RECORDS = 1_000_000  # most records of a file
FAST = {"zlib.compress.level": "BEST_SPEED"}


class Workspace:
    """Everything derived from one set of base tables that more than one analysis reads.

    The kept tables are far smaller than the base tables (one row per customer) and are written once to the cluster's
    shared folder. Fitted models are a few numbers each.
    """

    def __init__(self, tables: Tables):
        self.tables = tables
        self._factors: dict[str, DataFrame] = {}

    @cached_property
    def features(self) -> DataFrame:
        return features.customer_features(self.tables)

    @cached_property
    def keyed(self) -> Tables:
        """The base tables saved in the catalog by key and read back by name."""
        spark = self.tables.orders.sparkSession
        path = fresh_path(spark)
        prefix = path.rsplit("/", 1)[1].replace("-", "_")
        save_keyed(self.tables, prefix, path)
        return load_keyed(spark, prefix)

    @cached_property
    def from_csv(self) -> Tables:
        """The base tables written as CSV and scanned again. A compressed file is one task of the scan, so files are bounded."""
        spark = self.tables.orders.sparkSession
        path = fresh_path(spark)
        for name, df in self.tables.named().items():
            df.write.options(header=True, compression="gzip", maxRecordsPerFile=CSV_RECORDS, **FAST).csv(f"{path}/{name}")
        return load(spark, {name: f"{path}/{name}" for name in SCHEMAS}, "csv")

    def factor_rows(self, factor: str) -> DataFrame:
        """The rows a factor is tested on; its most frequent levels are looked up once."""
        if factor not in self._factors:
            self._factors[factor] = anova.factor_rows(self.features, factor)
        return self._factors[factor]

    @cached_property
    def fm(self) -> DataFrame:
        return keep(segments.fm_metrics(self.tables))

    @cached_property
    def segmented(self) -> DataFrame:
        return segments.fm_segments(self.fm)

    @cached_property
    def linear(self) -> regression.LinearFit:
        return regression.fit_linear(self.features)

    @cached_property
    def residuals(self) -> DataFrame:
        return regression.with_residuals(self.features, self.linear)

    @cached_property
    def logit(self) -> classify.LogitFit:
        return classify.fit_logit(self.features)

    @cached_property
    def class_split(self) -> DataFrame:
        """Complete rows of the classifier with their stratified hold-out mark."""
        return keep(splits.holdout(classify.complete_rows(self.features), label=classify.LABEL))

    @cached_property
    def scored(self) -> DataFrame:
        """Held-out rows scored by the classifier trained on the others."""
        scale = classify.population_scale(self.class_split)
        model = classify.fit_classifier(self.class_split.filter("is_test = 0"), scale)
        return classify.score_rows(self.class_split.filter("is_test = 1"), model)

    @cached_property
    def fold_auc(self) -> DataFrame:
        """One row per fold."""
        return keep(classify.fold_auc(self.features))

    @cached_property
    def tree_split(self) -> DataFrame:
        return keep(splits.holdout(self.features, label=classify.LABEL))

    @cached_property
    def tree(self) -> tree.Tree:
        return tree.grow_tree(self.tree_split.filter("is_test = 0"))


_open: dict[tuple[str, str], Workspace] = {}


def forget(base: str | None = None) -> None:
    """Forget what was derived from a folder (or from any), after its files were rewritten."""
    for key in [k for k in _open if base in (None, k[1])]:
        del _open[key]


def star_workspace(spark: SparkSession, base: str) -> Workspace:
    """The workspace of a star-schema folder, one per running application and folder, until it is forgotten."""
    key = (spark.sparkContext.applicationId, base)
    if key not in _open:
        _open[key] = Workspace(star_tables(spark, base))
    return _open[key]
