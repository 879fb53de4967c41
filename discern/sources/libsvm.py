"""LIBSVM text: ``label index:value ...`` with one-based, ascending indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """``label double, features sparse vector`` with zero-based indices.

    Give ``num_features``: it saves the pass that looks for the widest row and
    keeps training and scoring data equally wide.
    """
    reader = spark.read.format("libsvm").option("vectorType", "sparse")
    if num_features is not None:
        reader = reader.option("numFeatures", str(num_features))
    return reader.load(path)


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    """Write a vector column; the only text form that keeps sparse rows sparse."""
    df.select(F.col(label).cast("double").alias("label"), F.col(features).alias("features")).write.format(
        "libsvm"
    ).save(path)
