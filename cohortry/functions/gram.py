"""Sums of products of many columns.

Up to about a dozen columns, one SQL sum per pair stays inside generated code. Beyond, the sums are blocks: every task multiplies
its rows as matrices, batch by batch, and passes on one matrix per key. These are added up entry by entry.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_SUMS = 100  # the fields that generated code takes by default


def _products(width: int, weights: int):
    """From batches of (key, weights, columns) to (key, entry, total): the entries of the sums' matrices, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]).astype(float, copy=False)
            for k in np.unique(key):
                own = rows[key == k]
                w, x = own[:, :weights], np.column_stack([np.ones(len(own)), own[:, weights:]])
                total = totals.setdefault(int(k), np.zeros((width + weights, width + 1)))
                total[: width + 1] += (x * w[:, :1]).T @ x
                total[width + 1 :] += w[:, 1:].T @ x
        for k, total in totals.items():
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), k, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
                names=["key", "entry", "total"],
            )

    return run


def product_sums(rows: DataFrame, key: str, weights: Sequence[str], columns: Sequence[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per key, with x the columns behind a leading 1: the sum of the first weight times x x', and of every further weight times x.

    Rows must have no nulls. Only finished matrices reach the driver, one per key.
    """
    k, w = len(columns), len(weights)
    parts = rows.select(F.col(key).cast("int"), *weights, *columns).mapInArrow(_products(k, w), "key int, entry int, total double")
    found = parts.groupBy("key", "entry").agg(F.sum("total").alias("total")).collect()
    out: dict[int, np.ndarray] = {}
    for r in found:
        out.setdefault(r["key"], np.zeros((k + w) * (k + 1)))[r["entry"]] = r["total"]
    return {m: (t.reshape(k + w, k + 1)[: k + 1], t.reshape(k + w, k + 1)[k + 1 :]) for m, t in out.items()}
