"""The six analyses written from files to files."""

import os

import pytest

from cohortry.plans import reports
from cohortry.plans.workspace import Workspace
from cohortry.sources.star import star_tables
from cohortry.sources.tables import SCHEMAS

BASE = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.exists(BASE), reason="needs the generated tables")


def test_command_writes_segments_from_csv(spark, tmp_path):
    for name, df in star_tables(spark, BASE).named().items():
        df.coalesce(1).write.option("header", True).csv(str(tmp_path / "in" / f"{name}.csv"))
    reports.main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--output-format", "csv", "--only", "segments"])
    written = spark.read.option("header", True).csv(str(tmp_path / "out/segments/segments"))
    ws = Workspace(star_tables(spark, BASE))
    assert {(r["segment"], int(r["frequency"])) for r in written.collect()} == {
        (r["segment"], r["n"]) for r in ws.segmented.groupBy("segment").count().withColumnRenamed("count", "n").collect()
    }
    assert sorted(os.listdir(tmp_path / "out/segments")) == ["popular_categories", "recommendations", "segments", "target_customers"]


def test_all_analyses(spark, tmp_path):
    ws = Workspace(star_tables(spark, BASE))
    paths = reports.write_reports(ws, str(tmp_path))
    assert {p.split("/")[0] for p in paths} == set(reports.REPORTS) and len(paths) > 60
    assert set(SCHEMAS) == set(ws.tables.named())
    for path in paths.values():
        assert len(spark.read.parquet(path).columns) >= 1
