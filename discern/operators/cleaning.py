"""Projection and cleaning of wide tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def all_but_last(df: DataFrame) -> list[str]:
    """Feature column names of a table whose label stands last."""
    return df.columns[:-1]


def reverse_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{name}`") for name in reversed(df.columns)])


def replace_token(df: DataFrame, mapping: Mapping[str, str], columns: Sequence[str] | None = None) -> DataFrame:
    """Replace whole string values, in every string column unless some are named.

    The columns stay strings; follow with :func:`cast_columns`.
    """
    return df.na.replace(dict(mapping), subset=list(columns) if columns else None)


def cast_columns(df: DataFrame, columns: Sequence[str] | None = None, to: str = "double") -> DataFrame:
    """Cast columns (all string columns by default); what does not parse becomes null."""
    if columns is None:
        columns = [field.name for field in df.schema.fields if isinstance(field.dataType, T.StringType)]
    return df.withColumns({name: F.col(f"`{name}`").try_cast(to) for name in columns})


def result_columns(scored: DataFrame, *keep: str, label: str = "label") -> DataFrame:
    """Label and ``Predicted_label``, and the probabilities as an array if the model has them."""
    columns = [F.col(name) for name in keep]
    columns += [F.col(label), F.col("prediction").alias("Predicted_label")]
    if "probability" in scored.columns:
        columns.append(vector_to_array("probability").alias("probability"))
    return scored.select(*columns)


def first_predictions(scored: DataFrame, ids: Sequence[str], n: int = 10, prediction: str = "prediction") -> DataFrame:
    """The first ``n`` predictions by id as text, a missing one shown as ``NaN``."""
    shown = F.coalesce(F.col(prediction).cast("string"), F.lit("NaN")).alias(prediction)
    return scored.orderBy(*ids).limit(n).select(*ids, shown)
