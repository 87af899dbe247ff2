"""Session helpers for tests, the bench and interactive use.

On a cluster the session belongs to the cluster: nothing in the library creates one or overrides its settings.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, app: str = "cohortry") -> SparkSession:
    """A small local session with the settings the tests and the bench run under."""
    cores = cores or os.cpu_count() or 1
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


RANGES_PER_TASK = 3
ROWS_PER_RANGE = 1_000_000


def shuffle_width(spark: SparkSession) -> int:
    """The session's shuffle width, two at least."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_count(spark: SparkSession, rows: int) -> int:
    """How many ranges the ordered operators cut so many rows into.

    Several for each shuffle task, since ranges are hashed over the tasks, and more where a range would grow beyond what a
    task sorts well. A row finds its range by halving, so their number costs little.
    """
    return max(RANGES_PER_TASK * shuffle_width(spark), -(-rows // ROWS_PER_RANGE))
