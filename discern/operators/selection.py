"""Supervised width reduction: the features that tell the classes apart, from sparse counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More classes or kept features than this are an error: both are lists on the driver.
MOST_CLASSES, MOST_KEPT = 1000, 65_536
#: Stored entries that a worker counts at a time: about 100 bytes each.
ENTRIES = 1 << 18


def presence_counts(df: DataFrame, label: str = "label", column: str = "features") -> DataFrame:
    """``place, label, n``: rows of each class in which a feature is not zero.

    Work follows the stored entries, not the width.  Rows of ``ENTRIES`` stored entries are counted at a time,
    whatever a batch holds, so a feature of every row sends one record for them.  Rows without label or vector are left out.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(column).isNotNull())
    rows = rows.select(F.col(label).cast("double").alias("label"), F.col(column).alias("features"))
    counted = rows.mapInArrow(_presence(), "place int, label double, n long")
    return counted.groupBy("place", "label").agg(F.sum("n").alias("n"))


def _presence(most: int = ENTRIES):
    """The function that workers run; all it needs is inside it, so they need not have this package."""

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Runs of rows of at most ``most`` stored entries, or one row of more."""
        import pyarrow.compute as pc

        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1).field("values")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, before = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, end - start)
            start, before = end, int(ends[end - 1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in (part for whole in batches for part in slices(whole)):
            labels, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            stored = vectors.field("values")
            lengths = pc.fill_null(pc.list_value_length(stored), 0).to_numpy(zero_copy_only=False)
            values = stored.flatten().to_numpy(zero_copy_only=False)
            places = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # dense rows: entry number
            sparse = np.repeat(vectors.field("type").to_numpy(zero_copy_only=False) == 0, lengths)
            places[sparse] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
            there = values != 0
            places, classes = places[there], np.repeat(labels, lengths)[there]
            kinds, kind = np.unique(classes, return_inverse=True)
            keys, n = np.unique(places * max(len(kinds), 1) + kind, return_counts=True)
            place, kind = np.divmod(keys, max(len(kinds), 1))
            arrays = [pa.array(place.astype(np.int32)), pa.array(kinds[kind], pa.float64()), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["place", "label", "n"])

    return count


def chi_squared(df: DataFrame, label: str = "label", column: str = "features") -> DataFrame:
    """``place, n_rows, statistic``: Pearson's statistic of presence against class, of each feature that occurs.

    A feature that every row has says nothing: 0.  Without rows the result is empty.
    """
    labelled = df.where(F.col(label).isNotNull() & F.col(column).isNotNull())
    sizes = labelled.groupBy(F.col(label).cast("double").alias("label")).agg(F.count("*").alias("n"))
    classes = sorted((r.label, r.n) for r in sizes.limit(MOST_CLASSES + 1).collect())
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    total = float(sum(n for _, n in classes))
    by_place = presence_counts(df, label, column).groupBy("place").agg(
        F.sum("n").alias("n_rows"), F.map_from_entries(F.collect_list(F.struct("label", F.col("n").cast("double")))).alias("own")
    )
    rows = F.col("n_rows").cast("double")
    # in the order of the classes, so that the digits do not depend on the order of rows
    statistic = F.lit(0.0)
    for value, n in classes:
        off = F.lit(total) * F.coalesce(F.col("own")[F.lit(value)], F.lit(0.0)) - rows * F.lit(float(n))
        statistic = statistic + off * off / (F.lit(float(n)) * rows * (F.lit(total) - rows))
    return by_place.select("place", "n_rows", F.when(rows < total, statistic).otherwise(0.0).alias("statistic"))


def best_features(df: DataFrame, k: int, label: str = "label", column: str = "features") -> DataFrame:
    """``rank, place, n_rows, statistic`` of the ``k`` features with the largest statistic, ties to the smaller place.

    Statistics are compared to nine digits after the point.  Fit it on training rows only.
    """
    if not 0 < k <= MOST_KEPT:
        raise ValueError(f"k must lie in 1..{MOST_KEPT}, got {k}")
    order = [F.round("statistic", 9).desc(), F.col("place")]
    top = chi_squared(df, label, column).orderBy(*order).limit(k)
    # k rows, a parameter: one task may number them
    ranked = top.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.round("statistic", 9)).alias("by"), "place", "n_rows", "statistic"))).alias("top"))
    ranked = ranked.select(F.posexplode("top").alias("at", "one"))
    return ranked.select((F.col("at") + 1).alias("rank"), "one.place", "one.n_rows", "one.statistic")


def selector(training: DataFrame, k: int, label: str = "label", column: str = "features", out: str = "selected") -> VectorSlicer:
    """A stage that cuts vectors down to the ``k`` best features of ``training``, sparse ones without making them dense."""
    places = [r.place for r in best_features(training, k, label, column).select("place").collect()]
    if not places:
        raise ValueError("no feature occurs in a labelled row")
    return VectorSlicer(inputCol=column, outputCol=out, indices=sorted(places))


def reduced(df: DataFrame, stage: VectorSlicer) -> DataFrame:
    """``df`` with the cut vectors in the place of the wide ones.  A row without a vector is an error, as for classifiers."""
    wide, cut = stage.getInputCol(), stage.getOutputCol()
    return stage.transform(df).drop(wide).withColumnRenamed(cut, wide)
