"""What several of the operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_GAPS = r"[^\p{L}\p{M}\p{N}]+"


def word_text(text: Column) -> Column:
    """Lower-case words of a text joined by single blanks. Null gives the empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WORD_GAPS, " "))


def free_name(taken: Sequence[str], base: str) -> str:
    """A column name no column of the table has."""
    lower = {c.lower() for c in taken}
    while base.lower() in lower:
        base += "_"
    return base


BATCH_ROWS = 512


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``BATCH_ROWS``, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def with_arrow_column(
    df: DataFrame, inputs: Sequence[Column], start: Callable[[], Callable[[list[pa.Array]], pa.Array]], field: T.StructField
) -> DataFrame:
    """Append a column computed by a Python function on Arrow arrays; all columns of the table pass through.

    ``start`` runs once a task and returns the function from the input arrays of at most ``BATCH_ROWS`` rows to the array of the
    new column. Only the inputs go to Python and only the new column comes back; Spark holds the other columns meanwhile. No row
    moves: the plan has no exchange. The function counts as not deterministic, so that no plan computes the column twice.
    """
    several = len(inputs) > 1

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compute = start()
        for b in batches:
            cols = [*b] if several else [b]
            for at in range(0, len(cols[0]), BATCH_ROWS):
                yield compute([c.slice(at, BATCH_ROWS) for c in cols])

    made = F.arrow_udf(run, field.dataType).asNondeterministic()
    return df.select("*", made(*inputs).alias(field.name))


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast an object whose class executors need not know. The result, called in a task, gives it back."""
    return lend(spark, value)[0]


def lend(spark: SparkSession, value: Any) -> tuple[Callable[[], Any], Callable[[], None]]:
    """As ``share``, with a function that frees the broadcast once the job that used it is done."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(packed.value), packed.destroy


def ship_by_value(module: str) -> None:
    """Task functions of the module travel with the job, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship_by_value(__name__)
