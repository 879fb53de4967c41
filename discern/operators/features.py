"""Feature vectors: assembling, indexing, hashing, imputing, reducing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, HashingTF, Imputer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discern.functions.text import url_tokens, word_tokens
from discern.operators.ranking import global_row_number

# Fixed value: the dense solver keeps a (columns x columns) triangle on the driver
# and accepts no more columns than this.
PCA_MAX_COLUMNS = 65_535


def assembler(columns: Sequence[str], out: str = "features", invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid=invalid)


def label_index(df: DataFrame, column: str, out: str = "label_index") -> DataFrame:
    """``value, n, label_index``: values by falling frequency, ties by ascending text."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    return global_row_number(counts, [F.col("n").desc(), F.col("value")], out)


def with_known_index(df: DataFrame, column: str, labels: Sequence[str], out: str = "label") -> DataFrame:
    """Index ``column`` by its place in ``labels``; anything else, null included, gets null.

    The classes go into the column's metadata, which spares each classifier the pass
    in which it would count them.
    """
    index = F.create_map(*[F.lit(x) for i, value in enumerate(labels) for x in (value, float(i))])
    metadata = {"ml_attr": {"type": "nominal", "name": out, "vals": list(labels)}}
    return df.withColumn(out, index[F.col(column).cast("string")].alias(out, metadata=metadata))


def categorical(columns: Sequence[str], suffix: str = "_index") -> StringIndexer:
    """Index several columns in one pass; values not seen in training get an index of their own."""
    return StringIndexer(inputCols=list(columns), outputCols=[c + suffix for c in columns], handleInvalid="keep")


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, dtype in df.dtypes if dtype == "string"]


def index_categories(df: DataFrame, label: str | None = None) -> DataFrame:
    """Replace every string column, and the label if named, by its category index.

    Missing values get the index after the last category.  Each column is joined with its
    :func:`label_index`, so no list of categories reaches the driver; the join broadcasts an
    index that the session's threshold allows and shuffles otherwise.  The columns are marked
    as categorical with their number of values.
    """
    columns = string_columns(df)
    if label is not None and label not in columns:
        columns.append(label)
    indexed = df
    for c in columns:
        index = label_index(df, c, f"{c}_index").select(F.col("value").alias(f"_{c}"), f"{c}_index")
        known = index.count()  # the index is a written table: no recount of the data
        indexed = indexed.join(index, F.col(c).cast("string") == F.col(f"_{c}"), "left")
        indexed = indexed.withColumn(f"{c}_index", F.coalesce(f"{c}_index", F.lit(known)).cast("double"))
        metadata = {"ml_attr": {"type": "nominal", "name": c, "num_vals": known + 1}}
        indexed = indexed.withColumn(f"{c}_index", F.col(f"{c}_index").alias(f"{c}_index", metadata=metadata))
    return indexed.select(*[F.col(f"{c}_index").alias(c) if c in columns else F.col(c) for c in df.columns])


def hashed_terms(df: DataFrame, text: str, width: int, kind: str = "words", out: str = "features") -> DataFrame:
    """Sparse term counts of the whole text, hashed into ``width`` positions.  No shuffle, no vocabulary."""
    tokens = {"words": word_tokens, "url": url_tokens}[kind](F.col(text))
    return HashingTF(inputCol="_tokens", outputCol=out, numFeatures=width).transform(
        df.withColumn("_tokens", tokens)
    ).drop("_tokens")


def imputer(columns: Sequence[str], strategy: str = "mean") -> Imputer:
    return Imputer(inputCols=list(columns), outputCols=list(columns), strategy=strategy)


def vector_width(df: DataFrame, column: str = "features") -> int:
    """Number of entries of a vector column, from its metadata or else its first row."""
    width = df.schema[column].metadata.get("ml_attr", {}).get("num_attrs")
    if width is None:
        row = df.select(column).first()
        if row is None:
            raise ValueError(f"no rows to read the width of {column} from")
        width = row[0].size
    return int(width)


def principal_components(df: DataFrame, k: int, column: str = "features", out: str = "pca_features") -> PCA:
    """PCA to ``k`` components, to be put in a Pipeline so that it sees training rows only."""
    width = vector_width(df, column)
    if width > PCA_MAX_COLUMNS:
        raise ValueError(f"{width} columns are too many for PCA; reduce them with fold_width or hashed_terms first")
    if not 0 < k <= width:
        raise ValueError(f"k must lie in 1..{width}, got {k}")
    return PCA(k=k, inputCol=column, outputCol=out)


def pca_pipeline(df: DataFrame, k: int, *stages: object, column: str = "features") -> Pipeline:
    return Pipeline(stages=[principal_components(df, k, column), *stages])


def fold_width(df: DataFrame, width: int, column: str = "features", out: str | None = None) -> DataFrame:
    """Fold a wide sparse vector to ``width``: entry ``i`` is added to entry ``i % width``.

    Rows stay in their partition.  Arrow batches go through numpy, so the work is
    proportional to the stored entries and not to the declared width.
    """
    target = out or column
    source = df.withColumn(target, F.col(column)) if target != column else df
    fold = _vector_folder(source.columns.index(target), width)
    metadata = {"ml_attr": {"num_attrs": width}}
    return source.mapInArrow(fold, source.schema).withMetadata(target, metadata)


def _vector_folder(position: int, width: int):
    """The function that workers run; all it needs is inside it, so they need not have this package."""

    def fold_vectors(vectors: pa.StructArray) -> pa.StructArray:
        import pyarrow.compute as pc

        stored = vectors.field("values")
        lengths = pc.fill_null(pc.list_value_length(stored), 0).to_numpy(zero_copy_only=False)
        values = stored.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(vectors)), lengths)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        sparse = np.repeat(pc.fill_null(vectors.field("type"), 0).to_numpy(zero_copy_only=False) == 0, lengths)
        indices = np.arange(len(values)) - starts  # dense rows: entry number
        indices[sparse] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
        keys, inverse = np.unique(rows * width + indices % width, return_inverse=True)
        # without any stored entry bincount gives integers
        folded = np.bincount(inverse, weights=values, minlength=len(keys)).astype(np.float64)
        offsets = pa.array(np.searchsorted(keys, np.arange(len(vectors) + 1) * width).astype(np.int32))
        fields = list(vectors.type)
        arrays = [
            pa.array(np.zeros(len(vectors), dtype=np.int8)),
            pa.array(np.full(len(vectors), width, dtype=np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array((keys % width).astype(np.int32)), type=fields[2].type),
            pa.ListArray.from_arrays(offsets, pa.array(folded), type=fields[3].type),
        ]
        return pa.StructArray.from_arrays(arrays, fields=fields, mask=vectors.is_null())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(position, batch.schema.field(position), fold_vectors(batch.column(position)))

    return fold


def covariance(df: DataFrame, column: str = "features", merges: int = 64) -> DataFrame:
    """``i, j, covariance`` (sample, i <= j) of an array-of-double column.

    Each task reduces its rows to one packed row: count, means, co-moments around them.  These
    are joined pairwise by the parallel update rule, in ``merges`` tasks and then in one, so no
    digits are lost at large means and the exchange has one row a task.  Rows of unequal length
    are an error; null rows are left out.
    """
    packed = "n long, mean array<double>, comoment array<double>"
    reduce_rows, merge_rows = _moments()
    parts = (
        df.filter(F.col(column).isNotNull())
        .select(F.col(column).cast("array<double>"))
        .mapInArrow(reduce_rows, packed)
        .repartition(merges)
        .mapInArrow(merge_rows, packed)
        .repartition(1)
        .mapInArrow(merge_rows, packed)
    )
    width = F.size("mean")
    cells = parts.select("n", "comoment", width.alias("d"), F.explode(F.sequence(F.lit(0), width - 1)).alias("i"))
    cells = cells.select("n", "comoment", "d", "i", F.explode(F.sequence("i", F.col("d") - 1)).alias("j"))
    value = F.get("comoment", F.col("i") * F.col("d") + F.col("j"))
    return cells.select("i", "j", F.try_divide(value, (F.col("n") - 1).cast("double")).alias("covariance"))


def _moments():
    """The functions that workers run; all they need is inside, so they need not have this package."""

    def joined(a, b):
        (n, mean, comoment), (m, other, product) = a, b
        if len(mean) != len(other):
            raise ValueError(f"rows of {len(mean)} and of {len(other)} entries have no covariance")
        shift, total = other - mean, n + m
        return total, mean + shift * (m / total), comoment + product + np.outer(shift, shift) * (n * m / total)

    def packed(state) -> pa.RecordBatch:
        n, mean, comoment = state
        arrays = [pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([comoment.ravel().tolist()])]
        return pa.RecordBatch.from_arrays(arrays, names=["n", "mean", "comoment"])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            widths = set(np.diff(batch.column(0).offsets.to_numpy()).tolist())
            if len(widths) > 1:
                raise ValueError(f"rows of {min(widths)} and of {max(widths)} entries have no covariance")
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            mean = x.mean(axis=0)
            own = (len(x), mean, (x - mean).T @ (x - mean))
            state = own if state is None else joined(state, own)
        if state is not None:
            yield packed(state)

    def merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for n, mean, comoment in zip(*(batch.column(k) for k in range(3))):
                mean = np.array(mean.as_py())
                own = (n.as_py(), mean, np.array(comoment.as_py()).reshape(len(mean), -1))
                state = own if state is None else joined(state, own)
        if state is not None:
            yield packed(state)

    return reduce_rows, merge_rows
