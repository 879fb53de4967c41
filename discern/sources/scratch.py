"""Scratch tables in the folder that every executor can reach.

Frames that are read many times (training folds, grouped scores) are written
once as parquet and read back.  A written table outlives lost executors and cuts
the lineage, which cached blocks do not.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one machine, may fall
    back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="discern-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root, deleted when the JVM ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    file_system, hadoop_path = _hadoop(spark, path)
    file_system.deleteOnExit(hadoop_path)
    return path


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table before the session ends."""
    file_system, hadoop_path = _hadoop(spark, path)
    file_system.delete(hadoop_path, True)


def materialize(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    path: str | None = None,
) -> DataFrame:
    """Write ``df`` once and return the table that was written.

    Vector columns are kept.  ``partition_by`` is for columns of very few values: a
    later filter on them skips whole directories, at the price of one file per task
    and value.  ``sort_by`` orders the rows inside each file, so that a filter skips
    pages without adding files.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    writer = (df.sortWithinPartitions(*sort_by) if sort_by else df).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Cache a frame for the length of a ``with`` block; for a few reads by one job."""
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()
