"""Session settings and the shared folder for tables written between jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_paths: list[str] = []

# Settings the jobs are designed for. AQE sizes the shuffle partitions from the
# measured bytes, so `shuffle.partitions` (left to the cluster) is only an upper
# bound, and splits hot keys in joins and rebalanced writes.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the recommended settings to a session builder."""
    for name, value in RECOMMENDED.items():
        builder = builder.config(name, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, for tables written between jobs.

    Driver and executors must all reach it, so no folder is assumed where none is named.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if not named:
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    return named.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_folder(spark)}/fiscal_ledger/{spark.sparkContext.applicationId}"


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job writes to."""
    path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def table_paths() -> list[str]:
    """All paths given out so far, in order."""
    return list(_paths)


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more, through Hadoop's file system."""
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_tables(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder, through Hadoop's file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
