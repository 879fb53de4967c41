"""Wide CSV files without a header: columns ``_c0 .. _cN``, label last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def wide_schema(n_features: int, label_type: T.DataType | None = None) -> T.StructType:
    """``n_features`` double columns and a label column at the end."""
    fields = [T.StructField(f"_c{i}", T.DoubleType()) for i in range(n_features)]
    fields.append(T.StructField(f"_c{n_features}", label_type or T.IntegerType()))
    return T.StructType(fields)


def read_wide_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    missing: str | None = None,
) -> DataFrame:
    """Read a headless CSV file.

    With a ``schema`` the file is parsed once.  Without one Spark makes an extra
    pass to infer the types; a column that holds a missing-value token such as
    ``?`` is then read as string, unless the token is named in ``missing``.
    """
    reader = spark.read.option("header", False)
    if missing is not None:
        reader = reader.option("nullValue", missing)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def write_wide_csv(df: DataFrame, path: str) -> None:
    """Write one CSV part per partition; column order is the file's order."""
    df.write.option("header", False).csv(path)
