"""Writing results: one directory per result table, or a set of them that readers see change as a whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "published.json"  # no leading underscore: Spark does not read such files
RUNS = "runs"


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write one result table as ``parquet`` or as ``csv`` with a header row."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_results(results: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Write several result tables below one folder, a directory each, and return their paths."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in results}
    for name, df in results.items():
        write_result(df, paths[name], fmt)
    return paths


def _files(spark: SparkSession, folder: str):
    """The Hadoop file context and path constructor for a folder on any file system Spark can write to."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), spark._jsc.hadoopConfiguration()), path


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """What the folder publishes now: run, format, path below the folder by table name, and the run before. None before the first run."""
    path = f"{folder.rstrip('/')}/{MANIFEST}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def publish_results(results: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Write several result tables so that readers see all of them or none, and return their paths.

    Every run writes to a staging folder of its own; only when the last table stands does one rename, which replaces the old file in
    one step, put the new manifest in place. A run that fails leaves the published tables as they were. Readers that
    have read the manifest go on with their run's files: those of the run before stay until the run after the next.
    """
    if not results:
        raise ValueError("nothing to publish")
    spark, base, run = next(iter(results.values())).sparkSession, folder.rstrip("/"), uuid.uuid4().hex
    old = manifest(spark, folder)
    paths = {name: f"{RUNS}/{run}/{name}" for name in results}
    files, path = _files(spark, base)
    try:
        for name, df in results.items():
            write_result(df, f"{base}/{paths[name]}", fmt, "errorifexists")
        staged = f"{base}/{RUNS}/{run}/{MANIFEST}"
        _write_text(spark, staged, json.dumps({"run": run, "format": fmt, "tables": paths, "before": old and old["run"]}))
    except BaseException:
        files.delete(path(f"{base}/{RUNS}/{run}"), True)
        raise
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    files.rename(path(staged), path(f"{base}/{MANIFEST}"), options)
    if old and old["before"]:
        files.delete(path(f"{base}/{RUNS}/{old['before']}"), True)
    return {name: f"{base}/{p}" for name, p in paths.items()}


def read_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables the folder publishes now, all of one run."""
    now = manifest(spark, folder)
    if now is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    reader = spark.read.format(now["format"])
    if now["format"] == "csv":
        reader = reader.option("header", True)
    return {name: reader.load(f"{folder.rstrip('/')}/{p}") for name, p in now["tables"].items()}
