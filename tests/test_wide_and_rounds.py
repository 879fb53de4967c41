"""Components of wide vectors against the exact solver, and training in rounds."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from discern.operators import rounds as R
from discern.operators.features import assembler
from discern.operators.wide_pca import project_wide, vector_entries, wide_components

WIDE = 1 << 18


def frame(spark, matrix, places, sparse=True):
    rows = []
    for i, x in enumerate(matrix):
        there = np.flatnonzero(x)
        rows.append((i, Vectors.sparse(WIDE, {int(places[j]): float(x[j]) for j in there}) if sparse else Vectors.dense(x.tolist())))
    return spark.createDataFrame(rows, ["id", "features"]).repartition(3)


def exact(matrix):
    centred = matrix - matrix.mean(axis=0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    return centred, s**2 / (len(matrix) - 1), v


@pytest.mark.parametrize("sparse", [True, False])
def test_vectors_within_the_sketch_are_exact(spark, sparse):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(150, 12)) * np.arange(1, 13) * (rng.random((150, 12)) < 0.6) + 5
    places = np.sort(rng.choice(WIDE, 12, replace=False)) if sparse else np.arange(12)
    df = frame(spark, matrix, places, sparse)
    centred, variances, v = exact(matrix)
    got = wide_components(df, 12)
    assert got.rows == 150 and np.allclose(got.variances, variances)
    loadings = {r.feature: (r.mean, r.loading) for r in got.loadings.collect()}
    table = np.array([loadings[int(p)][1] for p in places])
    assert np.allclose([loadings[int(p)][0] for p in places], matrix.mean(axis=0))
    assert np.allclose(np.abs(v @ table), np.eye(12), atol=1e-6)  # the same directions, up to sign
    scores = {r.id: r.components for r in project_wide(df, got).collect()}
    assert np.allclose(np.array([scores[i] for i in range(150)]), centred @ table)


def test_first_components_of_a_full_spectrum(spark):
    """More columns than the sketch has: the space of the first ones is found, closer with each pass."""
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.normal(size=(120, 120)))[0]
    matrix = rng.normal(size=(400, 120)) * 0.8 ** np.arange(120) @ basis
    places = np.sort(rng.choice(WIDE, 120, replace=False))
    df = frame(spark, matrix, places)
    _, variances, v = exact(matrix)
    residuals = []
    for power in (0, 2):
        got = wide_components(df, 8, oversample=6, power=power)
        loadings = {r.feature: r.loading for r in got.loadings.collect()}
        table = np.array([loadings[int(p)] for p in places])
        assert np.allclose(table.T @ table, np.eye(8), atol=1e-8)
        residuals.append(np.linalg.norm(v[:8].T - table @ (table.T @ v[:8].T)))
    assert residuals[1] < 0.02 and residuals[1] < residuals[0] and np.allclose(got.variances, variances[:8], rtol=1e-3)


def test_odd_rows_and_names(spark):
    rows = [(1, Vectors.sparse(WIDE, {7: 2.0}), "x", 1.0), (2, None, "y", 2.0), (3, Vectors.sparse(WIDE, {}), None, 3.0), (3, Vectors.sparse(WIDE, {7: 1.0, 9: 4.0}), "z", 4.0)]
    df = spark.createDataFrame(rows, ["id", "features", "row", "y"])
    got = wide_components(df, 5)
    matrix = np.array([[2.0, 0.0], [0.0, 0.0], [1.0, 4.0]])
    assert np.allclose(got.variances, exact(matrix)[1][:2]) and got.rows == 3  # no more components than there are
    out = project_wide(df, got)
    assert out.columns == ["id", "row", "y", "components"]
    lengths = {r.y: r.components and float(np.square(r.components).sum()) for r in out.collect()}
    centred = matrix - matrix.mean(axis=0)
    assert lengths[2.0] is None and np.allclose([lengths[1.0], lengths[3.0], lengths[4.0]], (centred**2).sum(axis=1))
    with pytest.raises(ValueError):
        wide_components(df.limit(1), 1)
    with pytest.raises(ValueError):
        wide_components(df, 0)
    entries = vector_entries(df.select("y", "features")).collect()
    assert {r.y: r.indices for r in entries} == {1.0: [7], 2.0: None, 3.0: [], 4.0: [7, 9]}


@pytest.fixture(scope="module")
def parts(spark):
    """Two classes; the training labels of a fifth of the rows are wrong, the validation's are not."""
    n = F.col("id")
    rows = spark.range(600).select(n, (n % 2).cast("double").alias("a"), (n * 37 % 101 / 101.0).alias("b"), (n * 53 % 89 / 89.0).alias("c"))
    wrong = (n % 5 == 0) & (n < 400)
    rows = rows.withColumn("label", F.when(wrong, 1 - F.col("a")).otherwise(F.col("a")))
    rows = assembler(["a", "b", "c"]).transform(rows).cache()
    return rows.where("id < 400"), rows.where("id >= 400")


def test_rounds_stop_and_keep_the_best(parts):
    training, validation = parts
    found = R.fit_in_rounds(training, validation, 2, (8,), rounds=12, iterations=5, patience=2, metric="accuracy", seed=1)
    log = sorted(tuple(r) for r in found.log.collect())
    figures = [r[2] for r in log]
    assert [r[0] for r in log] == list(range(len(log))) and [r[1] for r in log] == [5 * (k + 1) for k in range(len(log))]
    (chosen,) = [r[0] for r in log if r[3]]
    assert figures[chosen] == max(figures) and figures.index(max(figures)) == chosen and max(figures) == 1.0
    assert len(log) <= chosen + 3 or len(log) == 12
    hits = found.model.transform(validation).select(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert hits == figures[chosen]


def test_a_round_starts_from_the_last_ones_weights(parts):
    """Two rounds of five steps end lower than one of five: the solver goes on."""
    training, validation = parts

    def loss(model):
        own = F.when(F.col("label") == 1, F.get(F.col("p"), F.lit(1))).otherwise(F.get(F.col("p"), F.lit(0)))
        return model.transform(training).withColumn("p", vector_to_array("probability")).select(F.avg(-F.log(own))).first()[0]

    net = R.perceptron(training, 2, (8,), maxIter=5, seed=1)
    one = net.fit(training)
    two = net.copy({net.initialWeights: one.weights}).fit(training)
    assert loss(two) < loss(one)
    with pytest.raises(ValueError):
        R.fit_in_rounds(training, validation.limit(0), 2, (8,), rounds=1, iterations=1)
    with pytest.raises(ValueError):
        R.fit_in_rounds(training, validation, 2, (8,), rounds=0)
