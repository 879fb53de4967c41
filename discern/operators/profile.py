"""Column profile of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _comparable(field: T.StructField) -> Column:
    """A string that is equal exactly when the values are; long text goes as a digest."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.md5(column)
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.md5(F.to_json(column))
    if isinstance(field.dataType, T.FractionalType):
        column = F.when(column == 0, F.lit(0).cast(field.dataType)).otherwise(column)  # -0.0 equals 0.0
    return column.cast("string")


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """``column_name, data_type, n_rows, n_missing, n_distinct`` for each column.

    The exact form turns columns into rows and counts in two steps, so a value held
    by most rows is one record per task before the shuffle.  With ``exact=False``
    there is no shuffle of values at all: sketches are merged in a single pass.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    types = F.create_map(*[F.lit(x) for f in fields for x in (f.name, f.dataType.simpleString())])
    if exact:
        long = df.select([_comparable(f).alias(f.name) for f in fields]).unpivot(
            [], [f"`{f.name}`" for f in fields], "column_name", "value"
        )
        per_value = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
        counts = per_value.groupBy("column_name").agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
            F.count("value").alias("n_distinct"),
        )
    else:
        aggregates = [F.count("*").alias("n_rows")]
        for f in fields:
            column = F.col(f"`{f.name}`")
            aggregates.append(
                F.struct(
                    F.lit(f.name).alias("column_name"),
                    F.count_if(column.isNull()).alias("n_missing"),
                    F.approx_count_distinct(_comparable(f)).alias("n_distinct"),
                ).alias(f"s_{len(aggregates)}")
            )
        one = df.agg(*aggregates)
        counts = one.select("n_rows", F.inline(F.array(*[F.col(c) for c in one.columns[1:]])))
    return counts.select(
        "column_name", types[F.col("column_name")].alias("data_type"), "n_rows", "n_missing", "n_distinct"
    )


def distinct_count(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows over ``columns`` (all by default); rows with a null are not counted."""
    names = columns or tuple(df.columns)
    return df.agg(F.count_distinct(*[F.col(name) for name in names]).alias("n_distinct"))
