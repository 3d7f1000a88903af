"""Reading of input tables and the few places where a plan is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``; columns are pruned by the caller's select."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, as configured; without a setting a local one, on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not configured:
            configured = tempfile.mkdtemp(prefix="tideglass-checkpoint-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors lose no work."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def _path(spark: SparkSession, path: str):
    """(file system, path) of the cluster's storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate data that no later reader needs."""
    fs, at = _path(spark, path)
    fs.delete(at, True)


def bounded_rows(df: DataFrame, bound: int, what: str) -> list:
    """All rows of a table that must be small; more than ``bound`` rows are an error, never a silent cap."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what} has more than {bound} rows; this path is only for bounded tables")
    return rows
