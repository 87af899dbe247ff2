"""Intermediate tables that several queries or steps read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session that names none (tests, a notebook) gets a folder of its own, removed when Python ends. A
    cluster must name one: its executors do not see each other's disks.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="cohortry-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder. What is written there is removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/cohortry-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    return path


def keep(df: DataFrame) -> DataFrame:
    """Write a table once and read it back.

    Readers start from columnar files instead of the lineage: they read only the columns they use, plans can tell the
    table's size and share the shuffles they have in common, and losing executors loses nothing.
    """
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
