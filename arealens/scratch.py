"""Intermediate tables in the folder that the whole cluster shares.

A written table cuts lineage and survives the loss of any executor. The folder is the one named by
``spark.checkpoint.dir``; only where that setting is absent and all runs in one process (tests, a laptop) is a local one made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a new local one if the session names none and runs in one process, else ``RuntimeError``."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="arealens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/arealens/{uuid.uuid4().hex}/{name}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, with that codec or the session's, and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` returned, once nothing still to be computed reads them."""
    for df in tables:
        _delete(df.sparkSession, df._scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete what ``stage`` wrote in this application; results read from it must be stored first."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
