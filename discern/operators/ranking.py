"""Exact running sums over a totally ordered table, without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FractionalType, LongType, StructField, StructType

from discern.sources.scratch import materialize


def prefix_sums(df: DataFrame, order_by: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """Add ``before_<c>``: the sum of ``c`` over all rows that sort earlier.

    ``order_by`` must order the rows totally, which it does when ``df`` is grouped
    by these columns.  Then a value that fills a third of the raw table is one row
    here and the ranges come out even.

    The one shuffle is the range partitioning of the sort.  Each sorted range runs its own
    sums and is written once; the ranges' totals (one row per range) give their offsets.
    """
    ordered = df.orderBy(*order_by).withColumn("_range", F.spark_partition_id())
    kinds = [DoubleType() if isinstance(df.schema[c].dataType, FractionalType) else LongType() for c in sums]
    schema = StructType([*ordered.schema.fields, *[StructField(f"before_{c}", k) for c, k in zip(sums, kinds)]])
    places = [ordered.columns.index(c) for c in sums]
    rows = materialize(ordered.mapInArrow(_running(places, [isinstance(k, DoubleType) for k in kinds]), schema), "ordered")
    totals = rows.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_offset_{c}") for c in sums])
    return (
        rows.join(F.broadcast(offsets), "_range")  # one row per range
        .withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_offset_{c}") for c in sums})
        .drop("_range", *[f"_offset_{c}" for c in sums])
    )


def _running(places: Sequence[int], fractional: Sequence[bool]):
    """The function that workers run; all it needs is inside it, so they need not have this package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc

        reached = [0.0 if f else 0 for f in fractional]
        for batch in batches:
            columns, names = list(batch.columns), list(batch.schema.names)
            for k, (place, f) in enumerate(zip(places, fractional)):
                own = pc.fill_null(batch.column(place).cast(pa.float64() if f else pa.int64()), 0)
                upto = pc.add(pc.cumulative_sum(own), reached[k])
                columns.append(pc.subtract(upto, own))
                names.append(f"before_{k}")
                if len(upto):
                    reached[k] = upto[-1].as_py()
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def global_row_number(df: DataFrame, order_by: Sequence[Column], name: str = "row_number") -> DataFrame:
    """Zero-based position of each row in the total order."""
    counted = prefix_sums(df.withColumn("_one", F.lit(1)), order_by, ["_one"])
    return counted.withColumn(name, F.col("before__one").cast("bigint")).drop("_one", "before__one")
