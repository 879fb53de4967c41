"""Principal components of wide or sparse vectors by a randomized range finder.

The rows are multiplied by a few dozen random sign columns, which the tasks make from hashes of the
entry numbers.  The products, made orthonormal, span nearly the same space as the first components; the
rows projected on that space give a small table with one row per entry number that occurs, and
the components follow from its second moments.  Only matrices of the sketch's width reach the driver;
nothing as wide as the vectors does.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from discern.operators.features import covariance
from discern.sources.scratch import materialize

SKETCH_SEED = 271828
#: Directions of the sketch whose variance is below this share of the largest are rounding.
NOTHING = 1e-12


@dataclass(frozen=True)
class WideComponents:
    """``loadings(feature, mean, loading)``: of each entry number that occurs its mean and its share in each component.

    ``variances`` are those of the components, ``rows`` the vectors they were taken from.
    """

    loadings: DataFrame
    variances: list[float]
    rows: int


def vector_entries(df: DataFrame, column: str = "features") -> DataFrame:
    """The vector column replaced by ``indices`` and ``values`` of its stored entries; null vectors give nulls."""
    others = [c for c in df.columns if c != column]
    fields = [df.schema[c] for c in others]
    made = [StructField("indices", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType()))]
    return df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{column}`")).mapInArrow(_entries(len(others)), StructType([*fields, *made]))


def _entries(position: int):
    """The function that workers run; all it needs is inside it, so they need not have this package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            vectors = batch.column(position)
            stored = vectors.field("values")
            lengths = pc.fill_null(pc.list_value_length(stored), 0).to_numpy(zero_copy_only=False)
            values = stored.flatten().to_numpy(zero_copy_only=False)
            sparse = np.repeat(pc.fill_null(vectors.field("type"), 0).to_numpy(zero_copy_only=False) == 0, lengths)
            indices = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            indices[sparse] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
            offsets, gone = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), vectors.is_null()
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x), mask=gone) for x in (indices.astype(np.int32), values.astype(np.float64))]
            names = [*batch.schema.names[:position], "indices", "values"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:position], *lists], names=names)

    return run


def _sketched(width: int, seed: int):
    """(row, indices, values) to (row, indices, values, y): the vector times ``width`` columns of random signs."""

    def signs(features: np.ndarray) -> np.ndarray:
        out = np.empty((len(features), width))
        for start in range(0, width, 64):
            h = (features.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + start)
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
            h ^= h >> np.uint64(31)
            own = range(start, min(width, start + 64))
            out[:, own] = 1.0 - 2.0 * ((h[:, None] >> np.arange(len(own), dtype=np.uint64)[None, :]) & np.uint64(1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, (1 << 21) // max(1, width * max(1, len(whole.column(1).flatten()) // max(1, whole.num_rows))))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                indices = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                values = batch.column(2).flatten().to_numpy(zero_copy_only=False)
                lengths = np.diff(batch.column(1).offsets.to_numpy())
                features, which = np.unique(indices, return_inverse=True)
                y = np.zeros((batch.num_rows, width))
                np.add.at(y, np.repeat(np.arange(batch.num_rows), lengths), values[:, None] * signs(features)[which])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, width, dtype=np.int32)), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["row", "indices", "values", "y"])

    return run


def _by_feature(mean: np.ndarray, basis: np.ndarray):
    """(indices, values, y) to (feature, total, b0 ..): the task's part of the projected table."""
    width = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["feature", "total", *[f"b{j}" for j in range(width)]]
        for whole in batches:
            step = max(1, (1 << 21) // max(1, width * max(1, len(whole.column(0).flatten()) // max(1, whole.num_rows))))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                indices = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                if not len(indices):
                    continue
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                q = (batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - mean) @ basis
                rows = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(0).offsets.to_numpy()))
                by = np.argsort(indices, kind="stable")
                starts = np.flatnonzero(np.append(True, indices[by][1:] != indices[by][:-1]))
                table = np.add.reduceat(values[by][:, None] * np.hstack([np.ones((len(by), 1)), q[rows[by]]]), starts, axis=0)
                columns = [pa.array(indices[by][starts].astype(np.int64)), *(pa.array(table[:, j]) for j in range(width + 1))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _turned(turn: np.ndarray, total: int):
    """(feature, total, b0 ..) to (feature, mean, loading)."""
    turn = np.ascontiguousarray(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = np.stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(2, 2 + len(turn))], axis=1) if batch.num_rows else np.zeros((0, len(turn)))
            loading = b @ turn
            offsets = pa.array((np.arange(batch.num_rows + 1) * turn.shape[1]).astype(np.int32))
            mean = batch.column(1).to_numpy(zero_copy_only=False) / total
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(mean), pa.ListArray.from_arrays(offsets, pa.array(loading.ravel()))], names=["feature", "mean", "loading"]
            )

    return run


def _moments(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred second moments (not divided) of an array column."""
    n, width = df.agg(F.count("*"), F.max(F.size(column))).first()
    if not n:
        return 0, np.zeros(0), np.zeros((0, 0))
    mean = np.array(df.agg(*[F.avg(F.col(column)[j]) for j in range(width)]).first(), float)
    out = np.zeros((width, width))
    if n > 1:
        for i, j, value in covariance(df, column, merges=16).collect():  # as many rows as the sketch has pairs of columns
            out[i, j] = out[j, i] = value * (n - 1)
    return n, mean, out


def wide_components(
    df: DataFrame, k: int, column: str = "features", oversample: int = 10, power: int = 1, seed: int = SKETCH_SEED
) -> WideComponents:
    """The first ``k`` principal components of a vector column of any width.

    The sketch has ``k + oversample`` columns.  ``power`` further passes multiply the sketch by the
    covariance, which sharpens it where variances fall off slowly.  Vectors of at most that rank
    are taken apart exactly; fewer components than ``k`` come out if there are no more.  Null
    vectors are left out.  Signs of components are arbitrary.
    """
    if k < 1 or oversample < 0 or power < 0:
        raise ValueError("k must be positive, oversample and power not negative")
    entries = vector_entries(df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{column}`").alias("features")).where("features IS NOT NULL"))
    rows = materialize(entries, "wide-rows")
    width = k + oversample
    schema = StructType([*rows.schema.fields, StructField("y", ArrayType(DoubleType()))])
    sketched = materialize(rows.mapInArrow(_sketched(width, seed), schema), "wide-sketch")
    for turn in range(power + 1):
        n, mean, gram = _moments(sketched, "y")
        if n < 2:
            raise ValueError("components need at least two rows")
        basis = _whitened(gram)
        table = sketched.select("indices", "values", "y").mapInArrow(
            _by_feature(mean, basis), ", ".join(["feature long", "total double", *[f"b{j} double" for j in range(basis.shape[1])]])
        )
        sums = [F.sum(c).alias(c) for c in table.columns[1:]]
        table = materialize(table.groupBy("feature").agg(*sums), "wide-table")
        parts = table.select(F.array(*table.columns[2:]).alias("b"))
        m, centre, spread = _moments(parts, "b") if basis.shape[1] else (0, np.zeros(0), np.zeros((0, 0)))
        values, vectors = np.linalg.eigh(spread + m * np.outer(centre, centre))
        best = np.argsort(-values)
        best = best[values[best] > NOTHING * max(values.max(initial=0.0), 0.0)]
        last = turn == power
        best = best[:k] if last else best
        turned = vectors[:, best] / np.sqrt(values[best])
        fields = "feature long, mean double, loading array<double>"
        loadings = materialize(table.mapInArrow(_turned(turned, n), fields), "wide-loadings")
        if last:
            return WideComponents(loadings, [float(v) / (n - 1) for v in values[best]], n)
        sketched = materialize(_projected(rows, loadings, len(best)).select("row", "indices", "values", "y"), "wide-sketch")
    raise AssertionError


def _whitened(gram: np.ndarray) -> np.ndarray:
    """A matrix that makes columns with these second moments orthonormal; directions without variance go."""
    values, vectors = np.linalg.eigh(gram)
    kept = values > NOTHING * max(values.max(initial=0.0), 0.0)
    return vectors[:, kept] / np.sqrt(values[kept])


def _projected(rows: DataFrame, loadings: DataFrame, width: int) -> DataFrame:
    """``rows(row, indices, values)`` with ``y``: the centred vector times the loadings.

    Entries meet their loadings by entry number; one record a row and task is then added up.
    """
    shift = loadings.agg(*[F.coalesce(F.sum(F.col("mean") * F.col("loading")[j]), F.lit(0.0)).alias(f"s{j}") for j in range(width)]).first()
    entries = rows.select("row", F.explode(F.arrays_zip("indices", "values")).alias("e")).select("row", F.col("e.indices").cast("long").alias("feature"), F.col("e.values").alias("value"))
    met = entries.join(loadings.select("feature", "loading"), "feature")
    sums = met.groupBy("row").agg(*[F.sum(F.col("value") * F.col("loading")[j]).alias(f"p{j}") for j in range(width)])
    joined = rows.join(sums, "row", "left")
    y = [F.coalesce(F.col(f"p{j}"), F.lit(0.0)) - F.lit(float(shift[j])) for j in range(width)]
    return joined.select(*rows.columns, F.array(*y).alias("y"))


def project_wide(df: DataFrame, components: WideComponents, column: str = "features", out: str = "components") -> DataFrame:
    """``df`` without its vector column and with ``out``, the centred vector in terms of the components.

    Null vectors give null.  Entry numbers that the components have not seen count as zero.
    """
    others = [c for c in df.columns if c != column]
    boxed = df.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), F.col(f"`{column}`").alias("features"))
    rows = materialize(vector_entries(boxed), "wide-input")
    projected = _projected(rows, components.loadings, len(components.variances))
    return projected.select(*[F.col("others").getField(c).alias(c) for c in others], F.when(F.col("indices").isNotNull(), F.col("y")).alias(out))
