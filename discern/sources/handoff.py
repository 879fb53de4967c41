"""Hand-off of a prepared split to a second training stage, as CSV directories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discern.sources.wide_csv import read_wide_csv, wide_schema


def write_split(df: DataFrame, path: str, features: Sequence[str], label: str, split: str = "split") -> None:
    """Write features then label, one directory per split, in a single pass."""
    df.select(*features, F.col(label), F.col(split)).write.partitionBy(split).option("header", False).csv(path)


def read_split(
    spark: SparkSession, path: str, value: object, n_features: int, num_classes: int, split: str = "split"
) -> DataFrame:
    """One split of a hand-off directory as ``features, label``."""
    return read_labelled_csv(spark, f"{path}/{split}={value}", n_features, num_classes)


def read_labelled_csv(
    spark: SparkSession,
    path: str,
    label_index: int,
    num_classes: int,
    n_columns: int | None = None,
) -> DataFrame:
    """CSV rows as ``features vector, label double``; the label stands at ``label_index``.

    A label outside ``0 .. num_classes - 1`` stops the job that meets it.  The
    check is part of the row expression and needs no pass of its own.
    """
    columns = n_columns or label_index + 1
    rows = read_wide_csv(spark, path, wide_schema(columns - 1, T.DoubleType()))
    names = rows.columns
    label = F.col(names[label_index]).cast("double")
    outside = label.isNull() | (label < 0) | (label >= num_classes) | (label != F.floor(label))
    message = F.concat(F.lit(f"label outside 0..{num_classes - 1}: "), F.coalesce(label.cast("string"), F.lit("null")))
    checked = F.when(outside, F.raise_error(message).cast("double")).otherwise(label)
    inputs = [name for i, name in enumerate(names) if i != label_index]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")
    return assembler.transform(rows.withColumn("label", checked)).select("features", "label")
