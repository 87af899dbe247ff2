"""Columns computed in Python: what goes there, and how often."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm import quality
from cohortry.llm.common import with_arrow_column

MB = 1 << 20


def traced():
    tracemalloc.start()

    def compute(cols):
        return pa.array([tracemalloc.get_traced_memory()[1]] * len(cols[0]), pa.int64())

    return compute


def test_other_columns_stay_out_of_python(spark):
    rows = spark.range(0, 400, 1, 1).select("id", F.repeat(F.col("id").cast("string"), 50_000).alias("body"))
    df = with_arrow_column(rows, [F.col("id")], traced, T.StructField("bytes", T.LongType()))
    assert df.columns == ["id", "body", "bytes"]
    found = df.agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"), F.max("bytes").alias("bytes")).first()
    assert found["n"] == 400 and found["chars"] == 50_000 * sum(len(str(i)) for i in range(400))
    assert found["bytes"] < 4 * MB  # the bodies have 54 MB


def test_rows_keep_their_values(spark):
    """Whatever the types of the other columns, over several batches and inputs."""
    span = F.expr("make_interval(0, 0, 0, 0, 0, 0, id)")
    rows = spark.range(0, 3000, 1, 3).select("id", span.alias("span"), F.lit(None).alias("none"))

    def add():
        return lambda cols: pa.array([a + b for a, b in zip(cols[0].to_pylist(), cols[1].to_pylist())], pa.int64())

    total = with_arrow_column(rows, [F.col("id"), F.col("id") + 1], add, T.StructField("total", T.LongType()))
    as_made = (F.col("total") == 2 * F.col("id") + 1) & F.col("span").cast("string").eqNullSafe(span.cast("string")) & F.col("none").isNull()
    assert total.count() == 3000 and total.filter(as_made).count() == 3000
    assert with_arrow_column(rows.limit(0), [F.col("id")], lambda: lambda cols: cols[0], T.StructField("same", T.LongType())).count() == 0


def test_each_text_is_judged_once(spark):
    docs = spark.createDataFrame([(i, f"A plain sentence of number {i}, and nothing else.") for i in range(50)], "doc_id long, text string")
    plan = quality.quality_scores(docs).filter("keep")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
