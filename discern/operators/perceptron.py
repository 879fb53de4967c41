"""Perceptrons fitted on weighted rows: equal rows are summed once before the solver's first pass.

Spark's perceptron has no weights and reads every row on each pass.  Here rows with the same label
and vector become one with their number, by a grouping that is exact on any input, and each pass
is a Spark job that sums loss and gradient of blocks of rows.  The fitted model is Spark's own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Entries of one dense block, and its most rows.
BLOCK_ENTRIES, BLOCK_ROWS = 1 << 19, 4096
# Settings of the line search and the solver's memory, those of Spark's.
CORRECTIONS, LEAST_FALL, LEAST_CURVE, TRIALS, KEPT_VALUES = 10, 1e-4, 0.9, 10, 20


def distinct_rows(df: DataFrame, label: str, features: str) -> DataFrame:
    """``label, features, n``: equal rows as one; counted inside each task before they are shuffled."""
    rows = df.select(F.col(label).cast("double").alias("label"), F.col(features).alias("features"))
    return rows.groupBy("label", "features").agg(F.count("*").alias("n"))


def _blocker(width: int, classes: int, block: int):
    """The function that workers run: weighted rows to dense blocks."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for whole in batches:
            for start in range(0, whole.num_rows, block):
                batch = whole.slice(start, block)
                labels = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                if not np.all((labels >= 0) & (labels < classes) & (labels == np.floor(labels))):  # null is NaN here
                    raise ValueError(f"label outside 0..{classes - 1}")
                vectors = batch.column(1)
                if vectors.null_count:
                    raise ValueError("a row has no feature vector")
                stored = vectors.field("values")
                lengths = pc.list_value_length(stored).to_numpy(zero_copy_only=False)
                values = stored.flatten().to_numpy(zero_copy_only=False)
                if not np.isfinite(values).all():
                    raise ValueError("a feature vector holds NaN or an infinite value")
                sparse = vectors.field("type").to_numpy(zero_copy_only=False) == 0
                sizes = np.where(sparse, pc.fill_null(vectors.field("size"), 0).to_numpy(zero_copy_only=False), lengths)
                if np.any(sizes != width):
                    raise ValueError(f"a feature vector is not {width} wide")
                places = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                places[np.repeat(sparse, lengths)] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
                x = np.zeros((len(labels), width))
                x[np.repeat(np.arange(len(labels)), lengths), places] = values
                n = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                cells = [pa.array([a.tobytes()], pa.binary()) for a in (x, labels.astype(np.int64), n)]
                yield pa.RecordBatch.from_arrays(cells, names=["x", "y", "n"])

    return blocks


def _summer(weights: np.ndarray, layers: Sequence[int]):
    """The function that workers run: blocks to (loss, rows, gradient), summed over the task."""

    def total(blocks: Iterator[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[float, float, np.ndarray]]:
        parts, at = [], 0
        for a, b in zip(layers, layers[1:]):
            parts.append((at, at + a * b, at + a * b + b))
            at += (a + 1) * b
        loss, rows, gradient = 0.0, 0.0, np.zeros(at)
        for x, y, n in blocks:
            y, n = np.frombuffer(y, np.int64), np.frombuffer(n)
            seen = [np.frombuffer(x).reshape(len(y), layers[0])]
            for k, (start, middle, end) in enumerate(parts):
                z = seen[-1] @ weights[start:middle].reshape(layers[k], -1) + weights[middle:end]
                seen.append(z if k == len(parts) - 1 else 1 / (1 + np.exp(-np.clip(z, -700, 700))))
            z = seen.pop()
            z = z - z.max(axis=1, keepdims=True)
            powers = np.exp(z)
            sums = powers.sum(axis=1)
            every = np.arange(len(y))
            loss += float(n @ (np.log(sums) - z[every, y]))
            rows += float(n.sum())
            delta = powers / sums[:, None]
            delta[every, y] -= 1
            delta *= n[:, None]
            for k in reversed(range(len(parts))):
                start, middle, end = parts[k]
                gradient[start:middle] += (seen[k].T @ delta).ravel()
                gradient[middle:end] += delta.sum(axis=0)
                if k:
                    delta = (delta @ weights[start:middle].reshape(layers[k], -1).T) * seen[k] * (1 - seen[k])
        yield loss, rows, gradient

    return total


class _SearchFailed(Exception):
    """No step along the direction does."""


def _step(value: Callable[[float], tuple[float, float]], first: float) -> float:
    """A step that meets the strong Wolfe conditions; ``value`` gives height and slope at a step."""

    def between(a: tuple, b: tuple) -> float:
        (l, fl, dl), (r, fr, dr) = sorted((a, b))
        d1 = dl + dr - 3 * (fl - fr) / (l - r)
        inside = d1 * d1 - dl * dr
        d2 = math.sqrt(inside) if inside >= 0 else math.nan
        t = r - (r - l) * (dr + d2 - d1) / (dr - dl + 2 * d2)
        return t if math.isnan(t) else min(max(t, l + 0.1 * (r - l)), l + 0.9 * (r - l))

    height, slope = value(0.0)
    if slope > 0:
        raise _SearchFailed

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(TRIALS):
            t = between(low, high)
            c = (t, *value(t))
            if c[1] > height + LEAST_FALL * t * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= LEAST_CURVE * abs(slope):
                return t
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise _SearchFailed

    t, low = first, (0.0, height, slope)
    for trial in range(TRIALS):
        c = (t, *value(t))
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > height + LEAST_FALL * t * slope or (c[1] >= low[1] and trial):
            return zoom(low, c)
        if abs(c[2]) <= LEAST_CURVE * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _SearchFailed


def minimise(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, iterations: int, tolerance: float) -> np.ndarray:
    """L-BFGS with the stopping rules of Spark's perceptron; ``objective`` gives value and gradient."""
    last: list = [None, None]

    def at(point: np.ndarray) -> tuple[float, np.ndarray]:
        if last[0] is None or not np.array_equal(last[0], point):
            last[:] = point, objective(point)
        return last[1]

    value, gradient = at(x)
    start, values, memory, failed = value, [math.inf], [], False
    done = 0
    while done < iterations and np.linalg.norm(gradient) > max(tolerance * abs(value), 1e-8):
        if len(values) > 1 and abs(value - max(values)) <= tolerance * start:
            break
        direction, used = gradient.copy(), []
        for s, y in memory:
            used.append((s @ direction) / (s @ y))
            direction -= used[-1] * y
        if memory:
            s, y = memory[0]
            direction *= (s @ y) / (y @ y)
        for (s, y), a in reversed(list(zip(memory, used))):
            direction += s * (a - (y @ direction) / (s @ y))
        direction = -direction

        def along(t: float, x: np.ndarray = x, direction: np.ndarray = direction) -> tuple[float, float]:
            height, slope = at(x + t * direction)
            return height, float(slope @ direction)

        try:
            step = _step(along, 1.0 if done else 1.0 / np.linalg.norm(direction))
            if not step * np.linalg.norm(gradient) >= 1e-10:
                raise _SearchFailed
        except _SearchFailed:
            if failed:
                break
            failed, memory = True, []
            continue
        failed, done = False, done + 1
        new = x + step * direction
        new_value, new_gradient = at(new)
        s, y = new - x, new_gradient - gradient
        memory = [(s, y), *memory][:CORRECTIONS] if s @ y > 0 else []
        x, value, gradient = new, new_value, new_gradient
        values = [*values, value][-KEPT_VALUES:]
    return x


class Perceptron(MultilayerPerceptronClassifier):
    """Spark's perceptron with another ``l-bfgs`` fit; settings, first weights and model are its own.

    The model's ``summary`` does not tell of the training.
    """

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        if self.getSolver() != "l-bfgs":
            return super()._fit(dataset)
        layers = [int(n) for n in self.getLayers()]
        spark, rows = dataset.sparkSession, max(1, min(BLOCK_ROWS, BLOCK_ENTRIES // max(layers)))
        weighted = distinct_rows(dataset, self.getLabelCol(), self.getFeaturesCol())
        blocks = weighted.mapInArrow(_blocker(layers[0], layers[-1], rows), "x binary, y binary, n binary")
        blocks = blocks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

        def objective(weights: np.ndarray) -> tuple[float, np.ndarray]:
            sums = blocks.mapPartitions(_summer(weights, layers))
            added = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2])
            loss, n, gradient = sums.treeAggregate((0.0, 0.0, 0.0), added, added)
            if not n:
                raise ValueError("no rows to fit a perceptron on")
            return loss / n, gradient / n

        # Spark draws the first weights and makes the model: fits of no iteration on one row
        blank = F.array_repeat(F.lit(0.0), layers[0])
        one = spark.range(0, 1, 1, 1).select(F.lit(0.0).alias(self.getLabelCol()), array_to_vector(blank).alias(self.getFeaturesCol()))
        still = self.copy({self.maxIter: 0})
        try:
            weights = minimise(objective, super(Perceptron, still)._fit(one).weights.toArray(), self.getMaxIter(), self.getTol())
        finally:
            blocks.unpersist()
        model = super(Perceptron, still.copy({self.initialWeights: Vectors.dense(weights)}))._fit(one)
        return model.copy({model.maxIter: self.getMaxIter()})
