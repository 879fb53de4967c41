"""Parquet tables of a data directory."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def register_tables(spark: SparkSession, directory: str, names: Iterable[str]) -> None:
    """Make tables visible to ``spark.sql`` as temporary views."""
    for name in names:
        read_table(spark, directory, name).createOrReplaceTempView(name)


PARTITIONS = "spark.discern.input.partitions"


def spread(df: DataFrame, ids: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Give a table ``partitions`` partitions by id before an iterative fit.

    Without the argument the session's ``spark.discern.input.partitions`` counts; without that the
    table stays as it was scanned.  It is for tables of fewer files than the cluster has cores: the
    caller knows them, and figures of a fit do not change with a table's size by themselves.
    """
    partitions = partitions or int(df.sparkSession.conf.get(PARTITIONS, "0"))
    return df.repartition(partitions, *ids) if partitions else df
