"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_RUNS: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder of a local session, and an error on a cluster.

    Executors on other machines would write to their own disks, and later reads would miss these rows. Within run_folder
    it is that block's folder.
    """
    if _RUNS:
        return _RUNS[-1]
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return _OWN[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that no DataFrame still to be run reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for tables that nothing reads after the block; it is deleted at its end."""
    path = new_path(spark, name)
    try:
        yield path
    finally:
        delete(spark, path)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for all tables on the way of the queries that are built and run within the block; it is deleted at its end.

    Results read these tables as they run, so write them elsewhere before the block ends.
    """
    with passing(spark, "run") as path:
        _RUNS.append(path)
        try:
            yield path
        finally:
            _RUNS.remove(path)


def stored(df: DataFrame, name: str, folder: str | None = None, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder (or to folder) and read back: its lineage ends here and it survives
    lost executors."""
    spark = df.sparkSession
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
