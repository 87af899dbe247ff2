"""The corpus pipeline: from ``documents`` to packed training batches.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as Parquet to the shared folder and the next
stage reads it back, so no stage repeats another's work and a lost executor costs one stage at most.

All columns of ``docs`` other than ``doc_id`` and ``text`` pass through unread, whatever their names; the last stage returns the
packing plan instead. Rows with a null id are kept or rejected by their text alone. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortry.llm import decontaminate, ngram_join, packing, quality, token_counts
from cohortry.sources.scratch import keep


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; so do null, empty and blank texts."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its bucket, batch and slot; lengths in pieces of the vocabulary."""
    return packing.pack(docs, vocabulary=token_counts.VOCABULARY)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: The classifier is trained and the classes are components of a graph: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
