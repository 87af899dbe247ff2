"""Tables of a catalog stored by key, and sets of results published as a whole."""

import os

import pytest
from pyspark.sql import functions as F

from cohortry.operators import features
from cohortry.plans import reports, workspace
from cohortry.plans.workspace import Workspace
from cohortry.sources import keyed, sinks
from cohortry.sources.star import star_tables

BASE = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(BASE), reason="needs the generated tables")


@needs_data
def test_nothing_is_shuffled_by_order(spark, tmp_path):
    names = keyed.save_keyed(star_tables(spark, BASE), "keyed_test", str(tmp_path / "base"), buckets=8)
    assert all(spark.catalog.tableExists(n) for n in names.values())
    t = keyed.load_keyed(spark, "keyed_test")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no table were small
        for df in (
            features.order_summary(t.order_items), features.order_payment(t.order_payments), features.order_review(t.order_reviews),
            features.delivered(t.orders).join(features.order_summary(t.order_items), "order_id", "left"),
        ):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        plan = features.order_features(t)._jdf.queryExecution().executedPlan().toString()
        by_order = [line for line in plan.splitlines() if "Exchange hashpartitioning(order_id" in line]
        assert len(by_order) <= 2  # items after the join by product: once by order and category, once by order
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plan = features.order_features(t)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(order_id" not in plan  # products are small and broadcast
    direct = features.customer_features(star_tables(spark, BASE))
    assert sorted(map(str, features.customer_features(t).collect())) == sorted(map(str, direct.collect()))


def failing(spark):
    return spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("x"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_failing_set_leaves_the_old_one(spark, tmp_path, fmt):
    folder = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        sinks.read_results(spark, folder)
    sets = [{f"t{i}": spark.range(run * 10 + i).selectExpr("id AS x") for i in range(1, 5)} for run in range(4)]
    with pytest.raises(Exception, match="broken"):
        sinks.publish_results({**sets[0], "t4": failing(spark)}, folder, fmt)
    with pytest.raises(FileNotFoundError):
        sinks.read_results(spark, folder)

    def sizes():
        return {n: df.count() for n, df in sinks.read_results(spark, folder).items()}

    sinks.publish_results(sets[0], folder, fmt)
    assert sizes() == {f"t{i}": i for i in range(1, 5)}
    held = sinks.read_results(spark, folder)
    with pytest.raises(Exception, match="broken"):
        sinks.publish_results({**sets[1], "t4": failing(spark)}, folder, fmt)
    assert sizes() == {f"t{i}": i for i in range(1, 5)}
    assert len(os.listdir(tmp_path / "out" / "runs")) == 1  # what failed is gone
    sinks.publish_results(sets[1], folder, fmt)
    assert sizes() == {f"t{i}": 10 + i for i in range(1, 5)}
    assert {n: df.count() for n, df in held.items()} == {f"t{i}": i for i in range(1, 5)}  # readers of the run before go on
    sinks.publish_results({"only": sets[2]["t1"]}, folder, fmt)
    assert sizes() == {"only": 21} and len(os.listdir(tmp_path / "out" / "runs")) == 2
    with pytest.raises(ValueError):
        sinks.publish_results({}, folder)


@needs_data
def test_reports_as_a_set(spark, tmp_path):
    paths = reports.publish_reports(Workspace(star_tables(spark, BASE)), str(tmp_path), ["segments", "comparison"])
    read = sinks.read_results(spark, str(tmp_path))
    assert set(read) == set(paths) and {n.split("/")[0] for n in read} == {"segments", "comparison"}
    assert read["segments/segments"].count() >= 1


@needs_data
def test_csv_copies_are_compressed_files_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(workspace, "CSV_RECORDS", 500)
    tables = star_tables(spark, BASE)
    back = Workspace(tables).from_csv
    for name, df in back.named().items():
        files = df.inputFiles()
        assert all(f.endswith(".csv.gz") for f in files) and len(files) >= tables.named()[name].count() / 500, name
    want = tables.order_items.select([F.col(c).cast(t) for c, t in back.order_items.dtypes])
    assert want.exceptAll(back.order_items).isEmpty() and back.order_items.exceptAll(want).isEmpty()  # doubles to the last bit
